import random

import numpy as np

from peakloom.llm import quality_classifier as Q


def unspaced(letters, seed, n=3000):
    r = random.Random(seed)
    return b"x" * 64 + "".join(r.choice(letters) for _ in range(n)).encode()


def test_unspaced_texts_of_one_prefix_are_told_apart():
    texts = [unspaced("abcdé" if i % 2 else "0123456", i) for i in range(60)]
    model = Q.train(texts, [i % 2 for i in range(60)])
    good, bad = model.score(unspaced("abcdé", 99)), model.score(unspaced("0123456", 99))
    assert good > 0.7 and bad < 0.3


def test_segments_hold_every_gram():
    word = unspaced("abcdeé", 1, 3 * Q.SEGMENT)
    parts = list(Q.segments(word))
    assert max(map(len, parts)) <= Q.SEGMENT and sorted(np.concatenate(parts)) == sorted(Q.features(word))
