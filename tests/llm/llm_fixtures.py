"""Small tables for the operators' tests, and plain-Python versions of what they compute."""

from __future__ import annotations

import random
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Columns whose names operators use inside.
CLASHING = ("id", "key", "i", "row", "n", "digest", "word", "words", "bits", "bucket", "shard", "score", "label", "spans", "doc", "leak", "t", "p", "t_id", "k_id", "k_text", "_maybe")


def documents(spark, rows, clashing: bool = True):
    """(doc_id, text) rows as a table like ``documents``, with extra columns named as the operators' own."""
    extra = CLASHING if clashing else ()
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in extra)
    full = [(i, t, "en" if i is None or i % 3 else None, "web", None if t is None else len(t), *(c for c in extra)) for i, t in rows]
    return spark.createDataFrame(full, schema)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def collected(df, key: str, *columns: str) -> dict:
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


def shingles(text: str | None, size: int) -> frozenset:
    words = SPACED.findall((text or "").translate(UPPER))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def near_components(rows, size: int, percent: int) -> list[int]:
    """The smallest id that each row reaches, by comparing all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min(least.get(r, i), i)
    return [least[find(k)] for k in range(len(rows))]


def repeats(rows, window: int) -> dict[int, tuple[list[str], list[bool]]]:
    """Words of each document (ids are unique), and which of them go."""
    words = {i: SPACED.findall(t or "") for i, t in rows}
    first: dict[tuple, tuple[int, int]] = {}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), (i, s))
    gone = {i: [False] * len(w) for i, w in words.items()}
    for i, w in words.items():
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (i, s):
                gone[i][s : s + window] = [True] * window
    return {i: (words[i], gone[i]) for i in words}


def leaks(text: str | None, items, size: int) -> tuple[int, int, list[str]]:
    """(words, words hit, item ids) of one document."""
    words = LETTERED.findall((text or "").translate(UPPER))
    hit, names = set(), set()
    for item, said in items:
        w = LETTERED.findall((said or "").translate(UPPER))
        n = min(size, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == w[s : s + n]:
                    hit.update(range(at, at + n))
                    names.add(str(item))
    return len(words), len(hit), sorted(names)
