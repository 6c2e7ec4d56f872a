"""The toxicity model is trained on the driver: what that holds beside the sample."""

import tracemalloc

import numpy as np

from weekwise.llm import toxicity


def test_training_holds_a_few_numbers_a_word():
    rng = np.random.default_rng(3)
    words = np.array(["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(20_000)])
    bodies = [" ".join(rng.choice(words, 500)) for _ in range(600)]
    toxic = np.arange(600) % 2
    tracemalloc.start()
    toxicity.fit(bodies, toxic, toxicity.ModelParams(bag_steps=2, text_steps=2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 85e6
