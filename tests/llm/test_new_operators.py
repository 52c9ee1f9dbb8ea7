"""Hard negatives, byte-level BPE and conversation repair against brute force, and on odd rows."""

import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from strandlake.llm import bpe, negatives, queries, repair

# ------------------------------------------------------------------ 11


@pytest.mark.parametrize("shape", [(1, 1, 1), (37, 64, 81), (40, 33, 65), (100, 100, 100), (5, 64, 200), (17, 0, 3)])
def test_strassen_is_the_exact_product(shape):
    rng = np.random.default_rng(sum(shape))
    a, b = rng.integers(-(10**6), 10**6, shape[:2]), rng.integers(-(10**6), 10**6, shape[1:])
    assert (negatives.strassen(a, b, 4) == a @ b).all()


def test_strassen_of_numbers_that_fill_64_bits():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 62), 1 << 62, (20, 24)), rng.integers(-(1 << 62), 1 << 62, (24, 30))
    got = negatives.strassen(a, b, 4)
    assert all(int(got[i, j]) == sum(int(x) * int(y) for x, y in zip(a[i], b[:, j])) for i in range(20) for j in range(30))


def slow_negatives(rows):
    """``rows``: (id, label, list of ints), no id twice."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for anchor, label, v in rows:
        if anchor % 100:
            continue
        near = sorted(((-dot(v, w), i, own == label) for i, own, w in rows if i != anchor and len(w) == len(v)))
        for score, positive, _ in [x for x in near if x[2]][:5]:
            fits = [x for x in near if not x[2] and 80 * -score <= 100 * -x[0] <= 100 * -score][:5]
            out += [(anchor, positive, k + 1, i, -score, -s) for k, (s, i, _) in enumerate(fits)]
    return sorted(out)


def test_negatives_equal_sql_and_brute_force(spark, sf):
    got = sorted(map(tuple, queries.op11_hard_negatives(spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert got == sorted(con.execute(queries.ORACLES["op11_hard_negatives"]).fetchall()) and len(got) > 20
    rows = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(256 * float(x))) for x in v]) for i, v, lab in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got == slow_negatives(rows)


def test_negatives_in_many_blocks_with_ties(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(3)) if i % 3 else 1, [float(x) / 256 for x in rng.integers(-3, 6, 6)]) for i in range(0, 4000, 10)]
    for name, size in (("ANCHOR_BLOCK", 7), ("CANDIDATE_BLOCK", 40), ("AT_ONCE", 3)):
        monkeypatch.setattr(negatives, name, size)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, negatives.mine(df, lambda i: i % 100 == 0).collect())) == slow_negatives([(i, n, [int(256 * x) for x in v]) for i, n, v in rows])


def test_negatives_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(100, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.9, 0.0]), (3, 2, None), (4, None, [1.0, 0.0]), (None, 2, [1.0, 0.0]), (5, 2, [inf, 0.0]), (6, 2, [nan, 0.0]), (7, 2, [None, 1.0]), (8, 2, [0.9, 0.0, 0.0]), (9, 2, []), (10, 2, [0.85, 0.0]), (2, 2, [0.9, 0.0]), (11, 1, [-1.0, 0.0]), (12, 2, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, label int, embedding array<double>, id string, v int")
    got = sorted(map(tuple, negatives.mine(df, lambda i: i % 100 == 0).collect()))
    assert got == [(100, 1, 1, 2, 65536, 58880), (100, 1, 2, 2, 65536, 58880), (100, 1, 3, 10, 65536, 55552)]
    assert negatives.mine(df.where("false"), lambda i: i % 100 == 0).count() == 0
    far = spark.createDataFrame([(100, 1, [1e300, 1.0]), (1, 1, [1e300, 1.0]), (2, 2, [1e300, 0.0])], "vec_id long, label int, embedding array<double>")
    assert [r["negative_id"] for r in negatives.mine(far, lambda i: i % 100 == 0).collect()] == [2]


# ------------------------------------------------------------------ 12


@pytest.fixture(scope="module")
def tiktoken_ids():
    import tiktoken

    ranks, pattern = bpe.default_ranks()
    encoding = tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
    return lambda text: np.array(encoding.encode_ordinary(text or ""), "<u4").tobytes()


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_bpe_equals_the_library(spark, sf, tiktoken_ids):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_bpe(spark, sf).collect()}
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert got == {i: (len(ids := tiktoken_ids(t)) // 4, sha(ids), sha((t or "").encode())) for i, t in texts.items()}


ODD_TEXTS = [
    None, "", " ", "\n\n \t", "don't we'll  I'd  ", "a" * 900, "'s" * 300, "x'sfoo " * 50, " " * 700 + "end", "\n" * 50 + "x" + "\n" * 51, "é ß 数" * 90, "𖺧aࢅ𞤀 \U0001fae9 \U00033027x" * 20,
    " ".join(f"w{i}'re  {i}\n" for i in range(400)), "12345 " * 100 + "!!!???" * 80, "<|endoftext|>" * 9, "\x1c\x1d \x85 　" * 60, "á" * 200, "日本語のテキスト。" * 60,
]


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (33, 16), (100, 3), (7, 3), (3, 1), (bpe.CHUNK, bpe.OVERLAP)])
def test_bpe_stitches_chunks(spark, tiktoken_ids, chunk, overlap):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(ODD_TEXTS)] + [(None, "null id " * 30, 0), (0, "again " * 40, 1)], "doc_id long, text string, ids int").repartition(3)
    got = sorted((r["id"] is None, r["id"], bytes(r["ids"])) for r in bpe.encode(df, chunk=chunk, overlap=overlap).collect())
    want = sorted((i is None, i, tiktoken_ids(t)) for i, t, _ in df.collect())
    assert got == want


def test_bpe_round_trip_and_edges(spark, tiktoken_ids):
    texts = [(1, "word%d " * 40_000 % tuple(range(40_000))), (2, "long " * 30_000 + "z" * 5_000 + " end" * 20_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    encoded = bpe.encode(df)
    assert {r["id"]: bytes(r["ids"]) for r in encoded.collect()} == {i: tiktoken_ids(t) for i, t in texts}
    assert {r["id"]: bytes(r["bytes"]).decode() for r in bpe.decode(encoded).collect()} == dict(texts)
    assert bpe.digests(bpe.encode(df.where("false"))).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(df, chunk=10, overlap=5)


def test_bpe_sees_the_classes_of_the_library(tiktoken_ids):
    own = bpe.coder(*bpe.default_ranks())
    for at in (0x80, 0x850, 0x1C80, 0xA7C0, 0x105C0, 0x10EC0, 0x16EA0, 0x1E6C0, 0x32620):
        for c in map(chr, range(at, at + 64)):
            text = f"a{c}a{c}1{c}!{c}{c} x"
            assert own.encode(own.pre_tokens(text)) == tiktoken_ids(text)


# ------------------------------------------------------------------ 13

FORM = re.compile(r"(s?(ua)+)?")


def slow_parse(kinds):
    """All edit strings of a few rows, by trying them: at most three insertions before each row and at the end."""
    best = None
    choices = [["D"] if k == "-" else ["D", "K", "R"] for k in kinds]
    for edits in itertools.product(*choices):
        kept = [(e, k) for e, k in zip(edits, kinds) if e != "D"]
        for gaps in itertools.product(range(3), repeat=len(kinds) + 1):
            roles = []
            options = []
            for n, (e, k) in zip(gaps, [*zip(edits, kinds), ("", "")]):
                options += [["u", "a"]] * n + ([[k.lower()]] if e == "K" else [["u", "a"]] if e == "R" else [])
            if len(options) > len(kinds) + 2 or len(options) % 2 and not (options and options[0] == ["s"]):
                continue
            if not any(FORM.fullmatch("".join(roles)) for roles in itertools.product(*options)):
                continue
            cost = sum({"K": 0, "R": 3, "D": 4}[e] for e in edits) + 3 * sum(gaps) + 3 * sum(k.isupper() for _, k in kept)
            audit = "".join("I" * n + e for n, e in zip(gaps, [*edits, ""]))
            best = min(best or (cost, audit), (cost, audit))
    return best


def parsed(kinds, block=None):
    parse = repair.Parse(repair.Chart())
    for k in kinds:
        parse.add(k)
    return parse.result()


def test_parse_equals_trying_all_edits():
    rng = np.random.default_rng(3)
    cases = ["", *"suaxSUAX-"] + ["".join(rng.choice(list("suaxSUAX-uauaua"), n)) for n in (2, 2, 3, 3, 3, 4, 4, 4, 4) for _ in range(8)]
    for kinds in cases:
        assert parsed(kinds) == slow_parse(kinds), kinds


def shortest(kinds):
    """Cheapest edits by relaxing (place, row) from the left: another way to the same answer."""
    at = {0: (0, "")}
    for k in [*kinds, None]:
        for _ in range(3):
            for p, (c, w) in list(at.items()):
                q = {0: 2, 1: 2, 2: 3, 3: 2}[p]
                at[q] = min(at.get(q, (1e9, "")), (c + 3, w + "I"))
        if k is None:
            return min(at[p] for p in (0, 3) if p in at)
        nxt = {}

        def go(p, way):
            nxt[p] = min(nxt.get(p, (1e9, "")), way)

        for p, (c, w) in at.items():
            go(p, (c + 4, w + "D"))
            if k != "-":
                more = 3 * k.isupper()
                if (q := {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((p, k.lower()))) is not None:
                    go(q, (c + more, w + "K"))
                go({0: 2, 1: 2, 2: 3, 3: 2}[p], (c + more + 3, w + "R"))
        at = nxt


def test_long_parses_equal_a_shortest_path():
    rng = np.random.default_rng(4)
    for n in (7, 8, 9, 15, 16, 17, 31, 63, 64, 65, 100, 399):
        kinds = "".join(rng.choice(list("suaxSUAX-uauauauaua"), n))
        assert parsed(kinds) == shortest(kinds), kinds


def test_all_splits_give_the_same_cell():
    rng = np.random.default_rng(6)
    chart = repair.Chart()
    for _ in range(20):
        kinds = "".join(rng.choice(list("suaxSUAX-"), 8))
        for k in range(1, 8):
            assert repair.combined(chart.block(kinds[:k]), chart.block(kinds[k:])) == chart.block(kinds)


def slow_repair(frame):
    """The whole contract for one table, row by row."""
    out = []
    for conv, rows in frame.groupby("conv_id", dropna=False):
        conv = None if pd.isna(conv) else int(conv)
        after = []
        for turn, role, text in zip(rows.turn, rows.role, rows.text):
            turn = None if pd.isna(turn) else int(turn)
            role, text = (" " if x is None else x for x in (role, text))
            how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if how == 1:
                text = ""
            if how == 2:
                text = re.sub("[.!?]", "", text)
            if how == 4:
                role = "user"
            after += [(turn, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in after:
            said = re.findall("[^\x20\x09-\x0d]", text)
            faults.append("b" if not said else "d" if (role, text) in seen else "" if said[-1] in ".!?" else "t")
            seen.add((role, text))
        kinds = ["-" if f in ("b", "d") else (k.upper() if f == "t" else k) for f, r in zip(faults, after) for k in [r[1][:1] if r[1][:1] in ("s", "u", "a") else "x"]]
        cost, audit = shortest(kinds)
        fixed, place, rest = [], 0, iter(after)
        for e in audit:
            new = "assistant" if place == 2 else "user"
            row = next(rest) if e != "I" else None
            if e == "D":
                continue
            role, text = (row[1] if e == "K" else new, row[2]) if row else (new, "")
            place = {"s": 1, "u": 2, "a": 3}[role[0]]
            fixed.append(f"{role}:{text}")
        assert FORM.fullmatch("".join(x[0] for x in fixed))
        turns = {r[0] for r in after if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        out.append((conv, gaps, *[faults.count(f) for f in "bdt"], illegal, cost, audit, sha("\n".join(fixed).encode())))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_held", [repair.MOST_HELD, 400])
def test_repair(spark, sf, most_held):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert sorted(map(tuple, repair.repair(df, most_held).collect()), key=str) == slow_repair(df.toPandas())


@pytest.mark.parametrize("most_held", [repair.MOST_HELD, 0])
def test_repair_of_odd_rows(spark, most_held):
    rng = np.random.default_rng(8)
    texts = ["Yes.", "no", "", " \t\x0b", "Why?!", "a.b \n", None, "x" * 50_000, " ", "Fine! \x1c"]
    roles = ["user", "assistant", "system", "tool", None, "User", "unknown", "", "user"]
    pick = lambda x: x[rng.integers(len(x))]
    rows = [(None if c == 11 else c, None if rng.random() < 0.1 else int(rng.integers(0, 9)), pick(roles), pick(texts)) for c in range(40) for _ in range(int(rng.integers(1, 12)))]
    rows += [(50, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(300)] + [(c, 0, "user", "One.") for c in range(100, 160)]
    rows += rows[:5]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, copy int").repartition(5)
    got = sorted(map(tuple, repair.repair(df, most_held).collect()), key=str)
    frame = df.select("conv_id", "turn", "role", "text").toPandas().astype({"role": object, "text": object})
    frame = frame.where(frame.notna(), None)
    assert got == slow_repair(frame)
    assert any(r[7] == "" and r[6] == 0 and r[8] == sha(b"") for r in got)
    assert repair.repair(df.where("false"), most_held).count() == 0
