"""What a worker remembers of the words it has encoded."""

import tracemalloc

import numpy as np
import pyarrow as pa

from placewise.llm import arrays
from placewise.llm.vocabularies import Memory


class Numbers:
    """Words split at blanks; a word's ids are its length and its first byte."""

    def words(self, data, bounds):
        blank = data == 0x20
        starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
        ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
        return starts, ends, arrays.owner(starts, bounds)

    def __call__(self, word):
        return [len(word), word[0]]


def test_remembered_words_take_little_memory_and_give_the_same_ids():
    memory = Memory(Numbers())
    memory.ids(*arrays.laid_out(pa.array(["warm up"], pa.large_string())))
    tracemalloc.start()
    for first in range(0, 200_000, 10_000):
        words = [f"w{i}" for i in range(first, first + 10_000)] + ["again"]
        ids, lengths = memory.ids(*arrays.laid_out(pa.array([" ".join(words)], pa.large_string())))
        assert ids.tolist() == [x for w in words for x in (len(w), ord(w[0]))] and lengths.tolist() == [2 * len(words)]
    del words, ids, lengths
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 15e6  # a dictionary of as many words takes some 30 MB
