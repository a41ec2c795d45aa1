"""Operator 10: byte-pair encoding and decoding by a deterministic tokenization automaton.

Compilation starts from one state that loops on every byte and applies the merges in order. The gadget of merge
``(u, v) -> t`` at time ``k`` splits the state that ``u`` leads to: its copy loses the arc ``v``, and every state that has an
arc ``u`` at that time gains an arc ``t`` to the state ``v`` leads to. All arcs of one label always lead to one state, so a
state is named by the label that enters it, and after all merges a word has exactly one path. Token ``y`` is an arc of the state of
``x`` unless some gadget removed a token of ``y``'s left spine from a state on ``x``'s right spine while both stood. Labels are
numbered so that what one gadget removes is a run of arcs from a run of states. After the last gadget the whole transition table is
laid out once, a row of sorted runs for each state (some 50,000 states, below a million runs); nothing is resolved later.

Encoding drives the table over the bytes of a pre-token in one pass without going back; decoding emits the labels of the arcs.

Cases: null and empty texts have no tokens and decode to the empty text; special strings in a text are one arc each, as in the
library; repeated rows are encoded each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bspgraph.llm.pretokens import BytePretokens, special_tokens
from bspgraph.llm.shared import bounded_batches
from bspgraph.llm.textops import chunks, trim, trimmed


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return letters | {chr(256 + k): b for k, b in enumerate(hidden)}


class BpeAutomaton:
    """``row``, ``low``, ``high``: the table. State ``x`` lacks the arcs whose place lies in one of its spans, entries ``row[x]`` to ``row[x + 1]``."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        letters = byte_letters()
        self.special = special
        self.label = {i: bytes(letters[c] for c in x) for x, i in vocab.items()}
        self.label |= {i: x.encode() for x, i in special.items()}
        #: label -> (time, left, right) of the gadget that made it
        self.made: dict[int, tuple[int, int, int]] = {}
        #: (u, v) -> time of the gadget that cut arc v from the state of u
        self.cut: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(merges):
            u, v, t = vocab[a], vocab[b], vocab[a + b]
            if not self._stands(u, v, k):
                continue  # no state of u has that arc any more: the gadget would change nothing
            if t in self.made:
                raise ValueError(f"two gadgets make {a + b!r}")
            self.made[t] = (k, u, v)
            self.cut[u, v] = k
        single = {i: x for i, x in self.label.items() if len(x) == 1}
        self.arcs = {x: i for i, x in self.label.items() if (i in self.made or i in single) and i not in special.values()}
        self._compile_states()
        self._compile_labels()
        del self.cut
        trim()

    def _spine(self, token: int, side: int, now: int) -> list[tuple[int, int]]:
        """(token, time its parent was made) down one side."""
        out, until = [], now
        while True:
            out.append((token, until))
            if token not in self.made:
                return out
            until, token = self.made[token][0], self.made[token][side]

    def _stands(self, x: int, y: int, now: int) -> bool:
        """Whether the state of ``x`` has arc ``y`` when gadget ``now`` is built. Of equal merges the left one goes first."""
        right, left = self._spine(x, 2, now), self._spine(y, 1, now)
        for a, a_until in right:
            for b, b_until in left:
                k = self.cut.get((a, b))
                if k is not None and k < a_until and k <= b_until:
                    return False
        return True

    def _places(self, side: int) -> tuple[dict[int, int], dict[int, tuple[list[int], list[int]]]]:
        """Numbers of the labels such that all that a gadget touches are neighbours, and each label's parts: (times, first numbers).

        A label comes after the labels that it ends (side 2) or begins (side 1), which follow each other by the time they were made.
        """
        labels = sorted(self.arcs.values(), key=lambda t: self.made[t][0] if t in self.made else -1)
        size = dict.fromkeys(labels, 1)
        for t in reversed(labels):
            if t in self.made:
                size[self.made[t][side]] += size[t]
        place, free, parts, at = {}, {}, {}, 0
        for t in labels:
            if t in self.made:
                time, part = self.made[t][0], self.made[t][side]
                free[t], free[part] = free[part], free[part] + size[t]
                times, firsts = parts.setdefault(part, ([], []))
                times.append(time)
                firsts.append(free[t])
            else:
                free[t], at = at, at + size[t]
            place[t] = free[t] + size[t] - 1
        return place, parts

    def _compile_states(self) -> None:
        """Resolve what all gadgets have cut into one table of rows.

        The gadget of ``(u, v)`` at time ``k`` takes arc ``v`` and all arcs begun by ``v`` since then from the state of ``u`` and those
        of all labels ended by ``u`` since then: a run of states, and the same run of arcs in each.
        """
        state, states = self._places(2)
        arc, arcs = self._places(1)
        runs = np.empty((len(self.cut), 4), np.int64)
        for n, ((u, v), k) in enumerate(self.cut.items()):
            first, begun = state[u], arc[v]
            if u in states and (i := bisect.bisect_right(states[u][0], k)) < len(states[u][0]):
                first = states[u][1][i]
            if v in arcs and (i := bisect.bisect_left(arcs[v][0], k)) < len(arcs[v][0]):
                begun = arcs[v][1][i]
            runs[n] = first, state[u] + 1, begun, arc[v]
        count = runs[:, 1] - runs[:, 0]
        own = np.repeat(runs[:, 0] - np.cumsum(count) + count, count) + np.arange(count.sum())
        low, high = np.repeat(runs[:, 2], count), np.repeat(runs[:, 3], count)
        by = np.lexsort((low, own))
        own, low, high = own[by], low[by], high[by]
        # Spans that touch become one. Rows are kept apart by a step larger than any place.
        step = len(arc) + 1
        reach = np.maximum.accumulate(own * step + high)
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (own[1:] * step + low[1:] > reach[:-1] + 1)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(own))[: len(heads)] - 1
        self.low, self.high = array("i", low[heads].astype(np.int32).tobytes()), array("i", (reach[tails] - own[tails] * step).astype(np.int32).tobytes())
        self.row = array("i", np.searchsorted(own[heads], np.arange(len(state) + 1)).astype(np.int32).tobytes())
        self.state, self.arc = state, arc

    def _compile_labels(self) -> None:
        """``root``: byte -> (the same for what follows it, the label that ends there or -1)."""
        self.root: dict[int, tuple[dict, int]] = {}
        none: dict[int, tuple[dict, int]] = {}
        for x, t in sorted(self.arcs.items(), key=lambda a: -len(a[0])):  # a longer label has made the way for those that begin it
            node = self.root
            for byte in x[:-1]:
                follow, _ = node.setdefault(byte, ({}, -1))
                node = follow
            node[x[-1]] = (node[x[-1]][0] if x[-1] in node else none, t)

    def step(self, x: int, y: int) -> bool:
        """Whether the state of ``x`` has arc ``y``: one look into its row."""
        row, place = self.state[x], self.arc[y]
        first = self.row[row]
        k = bisect.bisect_right(self.low, place, first, self.row[row + 1]) - 1
        return k < first or self.high[k] < place

    def encode(self, word: bytes) -> tuple[int, ...]:
        """Tokens of one pre-token.

        Every prefix of a word has one path, so each byte position has one state. One pass over the bytes sets them all: from the
        state of a position run the arcs that the state's row allows, and no other arc reaches where one of them ends.
        """
        whole = self.arcs.get(word)
        if whole is not None:
            return (whole,)
        n = len(word)
        root, row, low, high, state, arc, right_of = self.root, self.row, self.low, self.high, self.state, self.arc, bisect.bisect_right
        into = [-1] * (n + 1)  # the label that enters each position's state
        for at in range(n):
            # The start has every arc; ``step``, written out, tells which ones another state has.
            first = stop = 0
            if at:
                own = state[into[at]]
                first, stop = row[own], row[own + 1]
            node, to = root, at
            for byte in word[at:]:
                found = node.get(byte)
                if found is None:
                    break
                node, y = found
                to += 1
                if y >= 0 and into[to] < 0:
                    place = arc[y]
                    k = right_of(low, place, first, stop) - 1
                    if k < first or high[k] < place:
                        into[to] = y
        path, label = [], self.label
        while n:
            path.append(into[n])
            n -= len(label[into[n]])
        return tuple(reversed(path))

    def decode(self, ids) -> str:
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(2)
def automaton(path: str) -> BpeAutomaton:
    """The compiled automaton of a tokenizers file, one per worker."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    return BpeAutomaton(model["vocab"], merges, special_tokens(path))


class WordCache(dict):
    """Tokens by pre-token, in two generations of ``most`` entries: a word met again while it is in the old one moves to the new."""

    def __init__(self, auto: BpeAutomaton, most: int):
        super().__init__()
        self.auto, self.most, self.old = auto, most, {}

    def __missing__(self, x: str) -> tuple[int, ...]:
        got = self.old.get(x)
        if got is None:
            special = self.auto.special
            got = (special[x],) if x in special else self.auto.encode(x.encode())
            if len(x) > 48:
                return got
        self[x] = got
        return got

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Texts to ids, with a bounded cache of words."""

    def __init__(self, path: str, cache_size: int = 300_000):
        self.auto, self.split = automaton(path), BytePretokens(path).split
        self.words = WordCache(self.auto, cache_size)

    def ids(self, text: str) -> list[int]:
        self.words.turn()
        return list(itertools.chain.from_iterable(map(self.words.__getitem__, self.split(text))))


@functools.lru_cache(2)
def encoder(path: str, cache_size: int = 300_000) -> Encoder:
    return Encoder(path, cache_size)


def bpe_encode(spark: SparkSession, docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", cache_size: int = 150_000) -> DataFrame:
    """(id, ids array<int>) of every whole text. The cache is half of the round trip's, as the ids of a batch stay in memory beside it."""
    bounded_batches(spark)

    def encode(batches):
        ids = encoder(tokenizer, cache_size).ids
        for batch in chunks(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ids(x) if x else [] for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))], ["id", "ids"])

    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(trimmed(encode), schema).withColumnRenamed("id", id_column)


def bpe_decode(spark: SparkSession, tokens: DataFrame, tokenizer: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, text) from arrays of ids; a null array gives the empty text."""
    bounded_batches(spark)

    def decode(batches):
        text = automaton(tokenizer).decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text(x or ()) for x in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    schema = T.StructType([T.StructField("id", tokens.schema[id_column].dataType), T.StructField("text", T.StringType())])
    return tokens.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids")).mapInArrow(trimmed(decode), schema).withColumnRenamed("id", id_column)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, in one pass that keeps neither."""
    bounded_batches(spark)

    def both(batches):
        coder, digits = encoder(tokenizer), None
        label = coder.auto.label
        digits = {i: str(i) for i in label}
        for batch in chunks(batches, 1):
            n, first, second = [], [], []
            for text in batch.column(1).to_pylist():
                ids = coder.ids(text) if text else []
                n.append(len(ids))
                first.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                decoded = b"".join(map(label.__getitem__, ids)).decode("utf-8", "replace")
                second.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(trimmed(both), schema).withColumnRenamed("id", id_column)
