"""Token counts by a linear longest-match automaton.

The vocabulary is a byte trie. A state whose string is a token pops it (one token) and fails to the root; any other state
fails to where its parent's failure leads under the same byte, and its popped count is that of the tokens passed on the
way. Counting the greedy longest-match tokens of a word reads each byte once and builds no pieces. All distinct words of
a batch run through the automaton together, one byte at a time.

Defined cases: null and empty texts have no words and no tokens; a word that the vocabulary cannot cover counts as one
unknown token; repeated rows and extra columns pass through.
"""

from __future__ import annotations

import base64
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm.common import steps, words

RESULT = "struct<n_words: bigint, n_tokens: bigint>"


class Automaton:
    def __init__(self, vocabulary: list[bytes], lead: bytes = b" "):
        """lead: bytes before each word, as the vocabulary marks the begin of a word."""
        self.lead = lead
        child: list[dict[int, int]] = [{}]
        ends = [False]
        for token in vocabulary:
            s = 0
            for c in token:
                if c not in child[s]:
                    child[s][c] = len(child)
                    child.append({})
                    ends.append(False)
                s = child[s][c]
            ends[s] = s > 0
        fail, pops = [-1] * len(child), [0] * len(child)
        queue = deque([0])
        while queue:
            s = queue.popleft()
            for c, v in child[s].items():
                if ends[v]:
                    fail[v], pops[v] = 0, 1
                else:
                    z, n = fail[s], pops[s]
                    while z >= 0 and c not in child[z]:
                        n, z = n + pops[z], fail[z]
                    if z >= 0:
                        fail[v], pops[v] = child[z][c], n
                queue.append(v)
        edges = sorted((s << 8 | c, v) for s, kids in enumerate(child) for c, v in kids.items())
        self.keys, self.to = np.array([e[0] for e in edges] + [1 << 62]), np.array([e[1] for e in edges] + [-1])
        self.fail, self.pops = np.array(fail), np.array(pops)

    def go(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        key = states << 8 | data
        i = np.searchsorted(self.keys, key)
        return np.where(self.keys[i] == key, self.to[i], -1)

    def counts(self, distinct: pa.Array) -> np.ndarray:
        """Tokens of each word."""
        rows = [self.lead + x for x in distinct.cast(pa.binary()).to_pylist()]
        size = np.array([len(x) for x in rows], np.int64)
        data, start = np.frombuffer(b"".join(rows), np.uint8).astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        order = np.argsort(-size, kind="stable")
        state, total = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        lost = np.zeros(len(rows), bool)
        alive = np.searchsorted(-size[order], -np.arange(1, (size.max() if len(rows) else 0) + 1), side="right")
        for j, m in enumerate(alive):
            live = order[:m]
            live = live[~lost[live]]
            while len(live):
                to = self.go(state[live], data[start[live] + j])
                state[live[to >= 0]] = to[to >= 0]
                live = live[to < 0]
                total[live] += self.pops[state[live]]
                state[live] = self.fail[state[live]]
                lost[live[state[live] < 0]] = True
                live = live[state[live] >= 0]
        live = np.flatnonzero(~lost & (state > 0))
        while len(live):
            total[live] += self.pops[state[live]]
            state[live] = self.fail[state[live]]
            lost[live[state[live] < 0]] = True
            live = live[state[live] > 0]
        total[lost] = 1
        return total


@lru_cache(2)
def _automaton(data: bytes, lead: bytes) -> Automaton:
    return Automaton([base64.b64decode(line.split()[0]) for line in data.splitlines() if line.strip()], lead)


def count(df: DataFrame, vocabulary: str, *, text: str = "text", lead: bytes = b" ", into: str = "tokens") -> DataFrame:
    """df with a struct column (n_words, n_tokens). vocabulary: a file of lines "base64 rank" on the driver."""
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf(RESULT)
    def counted(texts: pa.Array) -> pa.Array:
        a, n_words, n_tokens = _automaton(shared.value, lead), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in steps(texts):
            codes, offsets, distinct = words(texts.slice(i, j - i))
            sums = np.concatenate([[0], np.cumsum(a.counts(distinct)[codes])])
            n_words.append(np.diff(offsets))
            n_tokens.append(np.diff(sums[offsets]))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_tokens).astype(np.int64))], ["n_words", "n_tokens"])

    return df.withColumn(into, counted.asNondeterministic()(F.col(text)))
