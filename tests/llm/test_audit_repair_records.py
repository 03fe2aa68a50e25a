"""Source divergence, conversation repair and token records against plain versions, their SQL, and damaged files."""

import functools
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter
from itertools import groupby

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from helpers import CLASHING, edge_docs, edge_rows, long_text, lower, same

from tierwise.llm import conversation_repair as CR
from tierwise.llm import source_divergence as SV
from tierwise.llm import token_records as TR
from tierwise.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def word_bpe():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def by_sql(name, **tables):
    """Rows of a query's SQL over tables of (columns with types, rows), columns in order of their names."""
    con = duckdb.connect()
    for table, (columns, rows) in tables.items():
        con.execute(f"create table {table} ({columns})")
        if rows:
            con.executemany(f"insert into {table} values ({', '.join('?' * len(rows[0]))})", rows)
    cursor = con.execute(ORACLE_SQL[name])
    at = sorted(range(len(cursor.description)), key=lambda i: cursor.description[i][0])
    return [tuple(r[i] for i in at) for r in cursor.fetchall()]


@pytest.fixture
def uncoalesced(spark):
    """Small shuffle partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def sorted_columns(df):
    return df.select(*sorted(df.columns))


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_conversation_repair"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    cursor = con.execute(ORACLE_SQL[name])
    at = sorted(range(len(cursor.description)), key=lambda i: cursor.description[i][0])
    assert [cursor.description[i][0] for i in at] == sorted(got.columns)
    same(sorted_columns(got), [tuple(r[i] for i in at) for r in cursor.fetchall()])


# source divergence


def divergence(rows, min_docs=30, top=50):
    """(lang, source, part, item, value, rank) of rows (lang, source, text)."""
    rows = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))) for a, b, t in rows]
    df, counts, groups = Counter(), Counter(), sorted({(a, b) for a, b, _ in rows})
    for a, _, w in rows:
        df.update((a, x) for x in set(w))
    for a, b, w in rows:
        counts.update((a, b, x) for x in w if df[a, x] >= min_docs)
    out = []
    for lang in {a for a, _ in groups}:
        terms = sorted(x for (a, x), n in df.items() if a == lang and n >= min_docs)
        own = [b for a, b in groups if a == lang]
        total = {b: sum(counts[lang, b, x] for x in terms) for b in own}
        p = {b: {x: 1 + 10**9 * (counts[lang, b, x] + 5) // (total[b] + 5 * len(terms)) for x in terms} for b in own}
        q = {x: 1 + 10**9 * (sum(counts[lang, b, x] for b in own) + 5) // (sum(total.values()) + 5 * len(terms)) for x in terms}
        for b in own:
            pairs = [(c, sum(abs(p[b][x] - p[c][x]) for x in terms)) for c in own if c != b]
            over = [(x, p[b][x] - q[x]) for x in terms if counts[lang, b, x] and p[b][x] > q[x]]
            for part, items, most in (("pair", pairs, None), ("term", over, top)):
                ranked = sorted(items, key=lambda i: (-i[1], i[0].encode()))[:most]
                out += [(lang, b, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return out


def audit_docs(seed=5, n=400):
    rng = random.Random(seed)
    words = ["The", "the", "Été", "été", "x", "don't", "naïve", "a1b", "ﬁ", "日本", "zebra", "Ünï", "[br]", "k_v"] + [f"w{chr(97 + i)}{chr(97 + i // 3)}" for i in range(26)]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "en", "fr", None]), rng.choice(["a", "a", "a", "b", "é", "", None, "zz"])
        rows.append((lang, source, " ".join(rng.choice(words[: rng.randint(1, len(words))]) for _ in range(rng.randint(0, 40)))))
    rows += [("de", "a", "nothing here"), ("de", "b", None), ("it", "only", ""), ("en", "a", long_text(20_000)), ("en", "empty", None)] + [("fr", "copies", "the the été zebra")] * 40
    return rows


def docs_frame(spark, rows):
    extra = (0, 0, 0, 0, 0, 0, True, 0, "x", "y", 0)
    return spark.createDataFrame([(i, *r, *extra) for i, r in enumerate(rows)], f"doc_id long, lang string, source string, text string, {CLASHING}")


@pytest.mark.parametrize("bounds", [{}, {"BLOCK_TERMS": 7, "TILE": 2}, {"BLOCK_ENTRIES": 5, "TILE": 1}, {"HELD": 50, "SLICE": 100}])
def test_divergence_against_a_plain_version(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(SV, name, value)
    rows = audit_docs()
    same(SV.source_divergence(docs_frame(spark, rows)).select("lang", "source", "part", "item", "value", "rank"), divergence(rows))


def test_divergence_equals_its_sql_on_edges(spark):
    rows = [(i, t, a, b) for i, (a, b, t) in enumerate(audit_docs(8, 150))]
    want = by_sql("op11_source_divergence", documents=("doc_id bigint, text varchar, lang varchar, source varchar", rows))
    same(sorted_columns(SV.source_divergence(docs_frame(spark, [(a, b, t) for _, t, a, b in rows]))), want)


def test_divergence_other_bounds_and_empty_table(spark):
    rows = audit_docs(9, 60)
    same(SV.source_divergence(docs_frame(spark, rows), min_docs=2, top=3).select("lang", "source", "part", "item", "value", "rank"), divergence(rows, 2, 3))
    assert SV.source_divergence(docs_frame(spark, [])).count() == 0


def test_a_pair_has_one_name_in_all_blocks():
    rows = [("en", 7, s, 2, [2], [n], 9, 2, 0, 0, 0) for s, n in (("b", 1), ("a", 3))]
    names = ["lang", "block", "source", "size", "ends", "counts", "total", "terms", "tile", "i", "j"]
    for given in (rows, rows[::-1]):
        found = SV._tile(pa.table([list(c) for c in zip(*given)], names=names)).to_pylist()
        assert [(r["a"], r["b"]) for r in found] == [("a", "b")]


def test_divergence_tells_long_terms_apart_whose_polynomials_agree(spark):
    turn = [bin(i).count("1") % 2 for i in range(1 << 11)]
    x, y = ("".join(pair[t] for t in turn) for pair in ("ab", "ba"))
    rows = [("en", "st"[i % 2], f"{x} {y} {y} common" if i % 3 else f"{y} common") for i in range(90)]
    same(SV.source_divergence(docs_frame(spark, rows)).select("lang", "source", "part", "item", "value", "rank"), divergence(rows))


def test_counting_takes_bounded_memory():
    rng = np.random.default_rng(4)
    text = [" ".join(rng.choice(["some", "words", "x" * 300, "of", "any", "length"], 3000)) for _ in range(130)]
    batch = pa.record_batch([pa.array(["en"] * len(text)), pa.array(["s"] * len(text)), pa.array(text)], names=["lang", "source", "text"])
    for one in SV.tx.slices(batch.column(2), 1 << 24):
        starts, ends, _ = one.words(SV.LETTERS)
        for most in (1, 1000, 1 << 16):
            assert (SV.word_hashes(one, starts, ends, most) == one.hashes(starts, ends)).all()
    SV.tx._powers[:] = [np.ones(1, np.uint64)] * 2
    tracemalloc.start()
    rows = [r for b in SV._counted(iter([batch]), SV.HELD, SV.SLICE) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {r["term"]: r["n"] for r in rows if r["term"]} == Counter(w for t in text for w in t.split())
    assert peak < 120e6  # of 20 MB of text


def test_runs_and_distances():
    rng = np.random.default_rng(2)
    for _ in range(200):
        size = int(rng.integers(1, 40))
        x, y = rng.integers(0, 3, (2, size))
        columns = [SV.runs_of(np.flatnonzero(c), c[c > 0], size) for c in (x, y)]
        for c, (ends, counts) in zip((x, y), columns):
            assert (np.repeat(counts, np.diff(ends, prepend=0)) == c).all() and (np.diff(counts) != 0).all()
        assert SV.distance(*columns) == np.abs(x - y).sum()


def test_large_counts_stay_exact(spark):
    big = np.array([0, 10**12, 7 * 10**15], np.int64)
    want = [1 + 10**9 * (int(c) + 5) // (10**16 + 5 * 1000) for c in big]
    assert SV.p_array(big, 10**16, 1000).tolist() == want
    df = spark.createDataFrame([(int(c), 10**16, 1000) for c in big], "c long, t long, v long")
    assert [r[0] for r in df.select(SV.p_of("c", "t", "v")).collect()] == want


# conversation repair


def cheapest(symbols):
    """(cost, letters) by a plain recursion over turns; an edit string is put together from its end."""

    @functools.cache
    def best(i, q, inserts):
        out = [(0, "")] if i == len(symbols) and q in (0, 3) else []
        due = 3 if q == 2 else 2

        def add(found, cost, letter):
            if found:
                out.append((found[0] + cost, letter + found[1]))

        if inserts:
            add(best(i, due, inserts - 1), 2, "I")
        if i < len(symbols):
            role, fault = symbols[i]
            add(best(i + 1, q, 3), 3, "D")
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                to = {"s": 1 if q == 0 else None, "u": 2 if q != 2 else None, "a": 3 if q == 2 else None}.get(role)
                if to:
                    add(best(i + 1, to, 3), more, "K")
                add(best(i + 1, due, 3), 2 + more, "R")
        return min(out) if out else None

    return best(0, 0, 3)


def repaired(rows):
    """The query's columns for rows (conv, turn, role, text), as rows in order of name."""
    groups = {}
    for conv, turn, role, text in rows:
        kept = groups.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        kept += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, symbols = set(), []
        for _, role, text in own:
            end = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated"
            seen.add((role, text))
            symbols.append((role[:1], fault))
        faults = Counter(f for _, f in symbols)
        cost, letters = cheapest(tuple(symbols)) if len(symbols) < 200 else (None, None)
        turns = [t for t, _, _ in own if t is not None]
        lines, k, q = [], 0, 0
        for x in letters or "":
            if x == "K":
                q = {"s": 1, "u": 2, "a": 3}[own[k][1][0]]
                lines.append(f"{own[k][1]}:{own[k][2]}")
            elif x in "IR":
                q = 3 if q == 2 else 2
                lines.append(("user:" if q == 2 else "assistant:") + (own[k][2] if x == "R" else ""))
            k += x != "I"
        out.append((
            letters, faults["blank"], conv, cost, faults["duplicate"], max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(symbols, symbols[1:])), hashlib.sha256("\n".join(lines).encode()).hexdigest(), faults["truncated"],
        ))
    return out


def talk(seed=3, conversations=60):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "User", None, "unknown"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, rng.choice(["Yes.", "No!", "so", "", " \n", None, "Why? \t", "é…", "a\nb.", "Yes."])))
    rows += [(None, None, None, None)] * 3 + [(None, 1, "user", "Hi."), (-7, None, "assistant", "Bye.")] + [(1000, None, "user", "again.")] * 30 + [(1001, i // 2, "user" if i % 2 else "assistant", f"t{i}.") for i in range(120)]
    return rows


def talk_frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, block long, cost long, symbols string")


@pytest.mark.parametrize("bounds", [(256, 1 << 16), (3, 1 << 16), (1, 1 << 16), (256, 10)])
def test_repair_against_a_plain_version(spark, monkeypatch, bounds):
    monkeypatch.setattr(CR, "BLOCK_ROWS", bounds[0])
    monkeypatch.setattr(CR, "BLOCK_CHARS", bounds[1])
    same(sorted_columns(CR.conversation_repair(talk_frame(spark, talk()))), repaired(talk()))


def test_repair_equals_its_sql_on_edges(spark):
    rows = [r for r in talk(6) if r[2] != ""]
    want = by_sql("op12_conversation_repair", conversations=("conv_id bigint, turn bigint, role varchar, text varchar", rows))
    same(sorted_columns(CR.conversation_repair(talk_frame(spark, rows))), want)


def test_runs_against_a_plain_recursion():
    rng = random.Random(1)
    for n in range(1500):
        word = "".join(rng.choice("suaoSUAOd") * (rng.randint(1, 6) if n % 3 == 0 else 1) for _ in range(rng.randint(0, 7)))
        plain = tuple(("?", "blank") if x == "d" else (x.lower(), "truncated" if x.isupper() else "") for x in word)
        runs = [(x, len(list(g))) for x, g in groupby(word)]
        cost = CR.before(runs, CR.END)[CR.START]
        assert CR._applied(CR.advanced(runs), CR.END)[CR.START] == cost
        k = rng.randint(0, len(runs))
        first, state = CR.unrolled(runs[:k], CR.before(runs[k:], CR.END), CR.START)
        second, state = CR.unrolled(runs[k:], CR.END, state)
        assert (cost, first + second + CR.finished(state)) == cheapest(plain)


def test_one_long_conversation_of_many_blocks(spark, uncoalesced):
    """A conversation of half of all rows, in pieces; its turns are those of the audit."""
    rows = [(1, i, "user" if i % 3 else "assistant", f"word {i}.") for i in range(4000)] + [(i, 0, "user", "Hi.") for i in range(2, 1000)]
    plain = CR.plain(talk_frame(spark, rows))
    pieces = CR.repaired_pieces(plain).filter("conv = 1").orderBy("block").collect()
    assert len(pieces) >= 15 and [p["last"] for p in pieces] == [False] * (len(pieces) - 1) + [True]
    edits = "".join(p["edits"] for p in pieces)
    assert len(edits.replace("I", "")) == 4000
    lines = [f"{r['role']}:{r['text']}" for r in CR.repaired_turns(plain).filter("conv = 1").orderBy("block", "place").collect()]
    roles = "".join(x[0] for x in lines)
    assert re.fullmatch("(s?(ua)+)?", roles)
    audit = CR.repair_audit(plain).filter("conv = 1").collect()[0]
    assert audit["audit"] == edits and audit["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    cost = sum({"K": 0, "R": 2, "D": 3, "I": 2}[x] for x in edits)
    assert audit["cost"] == cost == CR.before([("a" if i % 3 == 0 else "u", 1) for i in range(4000)], CR.END)[CR.START]


def test_repair_of_nothing(spark):
    assert CR.conversation_repair(talk_frame(spark, [])).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = CR.conversation_repair(talk_frame(spark, [(gone, 0, "user", "Hi.")])).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# token records


def tokens(rows, end=2):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(word_bpe())
    return [(i, own.encode(t or "", add_special_tokens=False).ids + [end]) for i, t in rows]


def summed(rows):
    """(id, start, n_tokens, crc) in the order of the files."""
    out, start = [], 0
    for i, ids in sorted(tokens(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ODD = ["A b c　d", "x\x1cy\x1dz\x85w", "é éé", " ́a", "ΣΑΣ ΣΣ Σ", "İstanbul ﬁ ① it's 'S 'Re", "<|endoftext|>x <|startoftext|> <| endoftext|>", "a\x00b \x00", "12 345,6", "日本 語", "​q‍ r", "The THE the, the. (the) [the]'s it's, 'tis ''s a-b_c a'-s 1,000.5 x=y;z #tag @me e\u0301, ,\u0301a É.É <|ENDOFTEXT|> <|endoftext|>", "Ǆ ǅ", "﻿bom"]


def test_records_round_trip_of_edges(spark):
    rows = [(5 * i, t) for i, t in enumerate([*ODD, *(t for _, t in edge_rows())])]
    same(TR.token_round_trip(edge_docs(spark, rows), word_bpe()), summed(rows))
    assert TR.token_round_trip(edge_docs(spark, []), word_bpe()).count() == 0


def test_records_of_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    same(QUERIES["op13_token_records"](spark, DATA), summed([tuple(r) for r in docs.select("doc_id", "text").collect()]))


def test_records_of_repeated_and_null_ids(spark, tmp_path, uncoalesced):
    """Each row is a record; starts leave no gap; an id of most rows is dealt over several files."""
    rows = [(None, "none"), (7, "seven"), *[(3, f"copy {i}") for i in range(500)], (None, None), (-2, "minus")]
    docs = edge_docs(spark, rows).repartition(4)
    TR.write_tokens(docs, str(tmp_path / "t"), word_bpe())
    got = TR.read_tokens(spark, str(tmp_path / "t")).orderBy("number").collect()
    assert [r["key"] for r in got] == [None, None, -2, *[3] * 500, 7]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    ids = [tuple(np.frombuffer(r["ids"], "<u4").tolist()) for r in got]
    assert Counter(ids) == Counter(tuple(x) for _, x in tokens(rows))
    assert len(list((tmp_path / "t").glob("*.rec"))) > 1
    with pytest.raises(ValueError, match="token records already"):
        TR.TokenRecords({"path": str(tmp_path / "t")}).writer(None, False)
    with pytest.raises(TypeError, match="integer"):
        TR.write_tokens(docs.withColumn("doc_id", docs["doc_id"].cast("string")), str(tmp_path / "u"), word_bpe())


def test_records_in_shuffled_order(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    TR.write_tokens(docs, str(tmp_path / "t"), word_bpe())
    plain = TR.read_tokens(spark, str(tmp_path / "t")).collect()
    mixed = TR.read_tokens(spark, str(tmp_path / "t"), seed=4).collect()
    assert sorted(mixed, key=lambda r: r["number"]) == sorted(plain, key=lambda r: r["number"])
    places = [r["number"] for r in mixed]
    assert places != sorted(places) and np.mean(np.abs(np.diff(places)) <= 1) < 0.1
    monkeypatch.setattr(TR, "SPLIT_BYTES", 1000)
    for seed in (None, 4):
        reader = TR.RecordReader(str(tmp_path / "t"), seed)
        parts = reader.partitions()
        numbers = [n for p in parts for b in reader.read(p) for n in b.column("number").to_pylist()]
        assert len(parts) > 5 and numbers == (places if seed else sorted(places))


def test_damaged_records_are_found(spark, tmp_path):
    TR.write_tokens(spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "doc_id long, text string").coalesce(1), str(tmp_path / "t"), word_bpe())
    path = max((tmp_path / "t").glob("*.rec"), key=lambda p: p.stat().st_size)
    whole = path.read_bytes()

    def numbers():
        reader = TR.RecordReader(str(tmp_path / "t"), None)
        return [n for p in reader.partitions() for b in reader.read(p) for n in b.column("number").to_pylist()]

    assert numbers() == list(range(50))
    for at, what in ((3, "length"), (9, "length"), (20, "payload"), (len(whole) - 2, "payload")):
        path.write_bytes(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
        with pytest.raises(ValueError, match=what):
            numbers()


def test_checksums_against_published_ones():
    data = np.frombuffer(b"123456789" + bytes(32) + b"\xff" * 32 + bytes(range(32)) + bytes(range(256)) * 40, np.uint8)
    spans = np.array([(0, 9), (9, 41), (41, 73), (73, 105), (105, len(data)), (105, 105 + 256), (105, 105 + 257)])
    got = TR.crc32c(data, spans[:, 0], spans[:, 1]).tolist()
    assert got[:4] == [0xE3069283, 0x8A9136AA, 0x62A8AB43, 0x46DD794E]

    def slow(raw):
        c = 0xFFFFFFFF
        for x in raw:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert got[4:] == [slow(data[a:b].tobytes()) for a, b in spans[4:]]
