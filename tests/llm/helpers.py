"""Documents for the edge cases, and plain versions of what the operators compute."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = r"[^\x20\x09-\x0D]+"
CLASHING = "n_words long, key long, hash long, bucket int, centre long, component_id long, kept boolean, row long, id string, spans string, sequence_id long"


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def long_text(n: int = 60_000) -> str:
    return " ".join(f"w{i * 7919 % 10007}x{i}" for i in range(n))


def edge_rows() -> list[tuple]:
    base = " ".join(f"word{i}" for i in range(80))
    near = base.replace("word40", "other40")
    texts = [None, "", " \n\t \n", "one two", "one two", base, base, near, "Ünïcode — “quotes” <|endoftext|> ﷺ 😀 " * 3, long_text(), long_text()[:-4] + "zzzz", base]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, "one two"), (None, base), (None, None), (5, "another text under an id that is taken " * 3)]
    return rows


def edge_docs(spark, rows=None):
    """doc_id, text and columns whose names the operators use inside."""
    rows = edge_rows() if rows is None else rows
    extra = (0, 0, 0, 0, 0, 0, True, 0, "x", "y", 0)
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, {CLASHING}")


def shingles(text: str | None, k: int = 5) -> set:
    w = re.findall(WORD, lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows: list[tuple], percent: int = 75) -> list[tuple]:
    """(id, shingles, smallest id reachable) of each row; null ids never name a component that has another."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = [None] * len(rows)
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            out[i] = (rows[i][0], len(sets[i]), min(ids) if ids and sets[i] else rows[i][0])
    return out


def repeated(rows: list[tuple], length: int = 50) -> list[tuple]:
    """(id, bytes, removed, spans, sha256 of the rest) of each row."""
    first: dict[bytes, float] = {}
    order = lambda i: float("inf") if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, float("inf")), order(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < order(i):
                cover[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if cover[k] and (k == 0 or not cover[k - 1]))
        out.append((i, len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest()))
    return out


def counts(text: str | None) -> tuple:
    s = text or ""
    w = re.findall(WORD, s)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in s.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(s.count(c) for c in "#*$%&|<>"), dup, len(cover)


def hits(rows: list[tuple], items: list[tuple], window: int = 13) -> list[tuple]:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    known: dict[tuple, set] = {}
    for i, t in items:
        w = re.findall(pattern, lower(t or ""))
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            known.setdefault(tuple(w[k : k + m]), set()).add(str(i))
    sizes = {len(k) for k in known}
    out = []
    for i, t in rows:
        w = re.findall(pattern, lower(t or ""))
        hit, found = set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if (x := known.get(tuple(w[k : k + m]))) is not None:
                    hit |= set(range(k, k + m))
                    found |= x
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def same(df, expected: list[tuple]) -> None:
    """Rows equal as a bag, nulls included."""
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(expected, key=repr)
