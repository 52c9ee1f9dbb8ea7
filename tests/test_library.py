"""Known answers, files, streams and invariants of the sequence library."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions.strings import metric, register_sql
from strandlake.operators import candidates as cand
from strandlake.operators import consensus as cons
from strandlake.operators import distance as dist
from strandlake.operators import experiments as exp
from strandlake.operators import profile as prof
from strandlake.operators import ledger as led
from strandlake.sources import datasets, fasta, specs, store, synthetic
from strandlake.streaming import feeds
from strandlake.tables import number, ranges


def seqs(spark, *rows, dataset="d"):
    return spark.createDataFrame([(dataset, i, s) for i, s in enumerate(rows)], "dataset_id string, seq_index int, sequence string")


def center(spark, text, dataset="d"):
    return spark.createDataFrame([(dataset, text)], "dataset_id string, center string")


def test_statistics(spark):
    s = seqs(spark, "ACGT", "ATGT", "GCGT")
    r = prof.info(s).first()
    assert (r["size"], r["alphabet"], r["total_chars"]) == (3, "ACGT", 12)
    assert r["diversity"] == pytest.approx(1 / 3)
    assert prof.diversity(seqs(spark, "AAAA", "TTTT", "ACGT")).first()["diversity"] == pytest.approx(10 / 12)


def test_quality(spark):
    r = dist.quality(seqs(spark, "AAAA", "AAAT", "TTTT"), center(spark, "AAAA")).first()
    assert (r["num_strings"], r["min_distance"], r["max_distance"], r["median_distance"], r["total_distance"], r["consensus_strength"]) == (3, 0, 4, 1.0, 5, 0.0)
    assert r["avg_distance"] == pytest.approx(5 / 3)


def test_quality_of_empty_pool(spark):
    r = dist.quality(seqs(spark, "AAAA").where("false"), center(spark, "AAAA")).first()
    assert (r["max_distance"], r["avg_distance"], r["median_distance"], r["consensus_strength"]) == (0, 0.0, 0.0, 1.0)


def test_compare_gives_ties_to_the_second(spark):
    r = dist.compare(seqs(spark, "AAAA", "TTTT"), center(spark, "AAAA"), center(spark, "GGGG")).first()
    assert (r["better"], r["avg_difference"]) == ("GGGG", -2.0)


def test_consensus(spark):
    s = seqs(spark, "ACGT", "AGCT", "ATCT")
    assert cons.results(s, cons.greedy_consensus(s), "c").first()["center_string"] == "ACCT"
    assert cons.results(s, cons.greedy_consensus(s), "c").first()["max_distance"] == 1


def test_metric_names():
    assert metric("  Hamming ") is metric("hamming")
    with pytest.raises(ValueError):
        metric("cosine")


def test_sql_functions(spark):
    register_sql(spark)
    assert spark.sql("SELECT hamming('ACGT', 'AGGA') AS d").first()["d"] == 2


def test_exact_radius(spark):
    s = seqs(spark, "ACGT", "AGGT", "ACGA").unionByName(seqs(spark, "AAAA", "AAAA", dataset="same"))
    got = {r["dataset_id"]: (r["radius"], r["center"]) for r in cand.smallest_radius(s).collect()}
    assert got["d"][0] == 1 and got["same"] == (0, "AAAA")
    assert cand.smallest_radius(seqs(spark, "AC", "ACG")).first()["success"] is False


def test_cluster_fallback(spark):
    r = cons.cluster_recombine(seqs(spark, "AAAA", "TTTT", "CCCC", "GGGG"), 0).first()
    assert r["fallback_used"]


def test_auto_radius(spark):
    r = cons.auto_parameters(seqs(spark, "ACGT", "ACGA", "ACGG", "ACGC")).first()
    assert (r["d"], r["n_blocks"]) == (2, 2)


def test_clusters_with_copies(spark):
    s = seqs(spark, "AAAA", "AAAA", "AAAT", "GGGG", "CCCC", "CCCC")
    got = {r["seq_index"]: r["cluster_id"] for r in cons.clusters(s, 1).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 4: 1, 5: 1}


def test_reported_distance_is_recomputed_distance(spark):
    s = seqs(spark, "ACGTACGT", "ACGAACGA", "TCGTACGA", "ACCTACGT")
    for made in (cons.block_heuristic(s, "ACGT", 4, 2, 2), cand.refine_greedy(s, center(spark, "TTTTTTTT"), 9), cand.refine_swap(s, center(spark, "CAGTACGT")), cand.refine_2opt(s, center(spark, "CAGTACGT"), 2)):
        r = made.first()
        again = dist.center_distances(s, center(spark, r["center"])).agg(F.max("d")).first()[0]
        assert r["max_distance"] == again
    best = cand.smallest_radius(s, 1e7).first()["radius"]
    assert best <= cons.block_heuristic(s, "ACGT", 4, 2, 2).first()["max_distance"]


def test_niche_keeps_distance(spark):
    rows = [("d", i, s, d) for i, (s, d) in enumerate([("AAAA", 1), ("AAAT", 2), ("AATT", 3), ("TTTT", 4), ("TTTT", 5)])]
    scored = spark.createDataFrame(rows, "dataset_id string, cand_no int, candidate string, max_d int")
    assert sorted(r["cand_no"] for r in cand.niche(scored, 2).collect()) == [0, 2, 3]


def test_niche_drops_copies_of_what_goes(spark):
    rows = [("d", i, s, d) for i, (s, d) in enumerate([("AAAA", 1), ("AAAT", 2), ("AAAT", 3), ("TTTT", 4), ("TTTT", 5), ("AAAT", 6)])]
    scored = spark.createDataFrame(rows, "dataset_id string, cand_no int, candidate string, max_d int")
    assert sorted(r["cand_no"] for r in cand.niche(scored, 2).collect()) == [0, 3]
    assert cand.niche(scored, 0).count() == len(rows)


def test_fasta(spark, tmp_path):
    (tmp_path / "one.fasta").write_text(">seq1\nACGTACGT\n\nGGCCTTAA\n>seq2 > more\nATGTACGT\nCCGGAATT")
    (tmp_path / "bare.fa").write_text("ACGT\nTT\n>x\n>y\nGG\n")
    got = {(r["dataset_id"], r["seq_index"]): r["sequence"] for r in fasta.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {("file_one", 0): "ACGTACGTGGCCTTAA", ("file_one", 1): "ATGTACGTCCGGAATT", ("file_bare", 0): "ACGTTT", ("file_bare", 1): "GG"}
    (tmp_path / "none.fasta").write_text(">a\n>b\n")
    with pytest.raises(ValueError):
        fasta.load(spark, "none", str(tmp_path))
    out = str(tmp_path / "out")
    fasta.write_fasta(seqs(spark, "ACGTACGT", "ATGTACGT"), out)
    text = "".join(p.read_text() for p in (tmp_path / "out").rglob("part-*"))
    assert text == ">seq_0\nACGTACGT\n>seq_1\nATGTACGT\n"


def test_synthetic_is_the_same_however_partitioned(spark):
    spec = spark.createDataFrame([("a", "random", 5, 8), ("b", "noise", 4, 6), ("c", "mutations", 6, 9), ("e", "clustered", 7, 5)], "dataset_id string, mode string, n int, length int")
    one = sorted(map(tuple, synthetic.synthetic(spec).collect()))
    assert one == sorted(map(tuple, synthetic.synthetic(spec.repartition(3)).collect()))
    assert len(one) == 22 and all(set(s) <= set("ACGTN") for _, _, s in one)
    assert len({len(s) for d, _, s in one if d == "c"}) == 1


def test_store_and_exports(spark, tmp_path):
    s = seqs(spark, "ACGT", "AC,GT\nA").unionByName(seqs(spark, "T", dataset="e"))
    store.save_sequences(s, str(tmp_path / "s"))
    assert store.load_sequences(spark, str(tmp_path / "s"), "e").count() == 1
    done = store.export_tables({"s": s, "none": s.where("false")}, str(tmp_path / "x"), ("csv", "json", "parquet"))
    assert {r["table_name"]: r["n_rows"] for r in done.collect()} == {"s": 3, "none": 0}
    assert spark.read.option("header", True).csv(str(tmp_path / "x/csv/s")).count() == 3
    assert not (tmp_path / "x/csv/none").exists()


def test_spec_tables(spark):
    spec = {"datasets": [{"id": "a", "type": "synthetic", "parameters": {"n": 5}}, {"id": "a"}], "presets": [{"id": "p", "algorithms": ["x", "y"]}], "tasks": [{"id": "t", "type": "experiment", "datasets": ["a", "b"], "presets": ["p"], "repetitions": 2}]}
    tables = specs.spec_tables(spark, spec)
    assert sorted(map(tuple, specs.problems(tables).collect())) == [("datasets: repeated id", "a"), ("tasks: unknown dataset_id", "b")]
    assert exp.units(exp.combinations(tables["tasks"], tables["presets"])).count() == 8


def test_streams_equal_their_batch_twins(spark, tmp_path):
    rows = [(e, i, float(i), p) for e in range(3) for i, p in enumerate([0.0, 0.005, 0.2, 0.205, 0.9, 1.0])]
    df = spark.createDataFrame(rows, "execution_id long, id long, ts double, progress double")
    df.write.parquet(str(tmp_path / "p"))
    stream = feeds.throttled_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "p")), 0.01, 0.5)
    query = stream.writeStream.format("memory").queryName("thr").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("thr").collect())) == sorted(map(tuple, feeds.throttled(df, 0.01, 0.5).collect()))
    moves = spark.createDataFrame([(1, "queued", 1.0), (1, "running", 2.0), (1, "running", 3.0), (2, "queued", 1.0)], "id long, status string, ts double")
    moves.write.parquet(str(tmp_path / "m"))
    stream = feeds.status_moves_stream(spark.readStream.schema(moves.schema).parquet(str(tmp_path / "m")))
    query = stream.writeStream.format("memory").queryName("mov").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(str, spark.table("mov").collect())) == sorted(map(str, feeds.status_moves(moves).collect()))


def test_methods(spark):
    s = seqs(spark, "ACGT", "AGGT", "ACGA")
    got = {r["method"]: r["max_distance"] for r in exp.run_methods(s, ["consensus", "cluster_recombine", "block_heuristic", "exact_radius"]).collect()}
    assert got["exact_radius"] == min(got.values()) == 1


def test_moves_keep_times_and_are_tried_in_order(spark):
    rows = spark.createDataFrame([(1, "queued", 5.0), (2, "completed", 7.0), (3, "paused", 9.0)], "id long, status string, updated_at double")
    moves = spark.createDataFrame([(1, "completed", 3.0), (1, "running", 2.0), (2, "running", 2.0), (1, "queued", 4.0), (3, None, 1.0)], "id long, new_status string, at double")
    new, refused = led.apply_moves(rows, moves)
    assert sorted(map(tuple, new.collect())) == [(1, "completed", 3.0), (2, "completed", 7.0), (3, "paused", 9.0)]
    assert sorted(map(tuple, refused.collect())) == [(1, "completed", "queued"), (2, "completed", "running")]


def test_datasets_by_spec(spark, tmp_path):
    (tmp_path / "one.fasta").write_text(">a\nACGT\n>b\nAGGT\n")
    rows = [("s", None, "synthetic", {"n": "4", "length": "6", "alphabet": "AC"}), (None, "mine", "file", {"filename": "one"}), ("x", "Feed", "external", {"min_length": "3", "uniform_policy": "trim"})]
    given = spark.createDataFrame(rows, "dataset_id string, name string, type string, parameters map<string,string>")
    landed = seqs(spark, "AC", "ACGT", "ACG", dataset="x").unionByName(seqs(spark, "TTTT", dataset="other"))
    made, known = datasets.load_datasets(given, str(tmp_path), landed)
    got = sorted((r["dataset_id"], r["seq_index"], r["sequence"]) for r in made.collect())
    assert [r for r in got if r[0] != "s"] == [("mine", 0, "ACGT"), ("mine", 1, "AGGT"), ("x", 1, "ACG"), ("x", 2, "ACG")]
    assert len([r for r in got if r[0] == "s" and len(r[2]) == 6 and set(r[2]) <= set("AC")]) == 4
    assert sorted((r["dataset_id"], r["name"]) for r in known.collect()) == [("mine", "mine"), ("s", "s"), ("x", "Feed")]
    with pytest.raises(ValueError):
        datasets.load_datasets(given.withColumn("type", F.lit("ftp")))


def test_datasets_in_a_folder(spark, tmp_path):
    (tmp_path / "one.fasta").write_text(">a\nACGT\n")
    (tmp_path / "two.fa").write_text(">a\nACGT\n")
    base = str(tmp_path)
    assert fasta.exists(spark, "one", base) and fasta.exists(spark, "one.fasta", base) and not fasta.exists(spark, "three", base)
    assert fasta.delete(spark, "one", base) and not fasta.delete(spark, "one", base)
    assert [r["name"] for r in fasta.listing(spark, base).collect()] == ["two"]


def test_spans_join_short_blocks(spark):
    lengths = spark.createDataFrame([("a", 10), ("b", 3)], "dataset_id string, length int")
    spans = lambda *a, **k: [(r["dataset_id"], r["l"], r["r"]) for r in prof.block_spans(lengths, *a, **k).orderBy("dataset_id", "l").collect()]
    assert spans("proportional", blocks=4, least=3) == [("a", 0, 2), ("a", 2, 5), ("a", 5, 10), ("b", 0, 3)] or spans("proportional", blocks=4, least=3)[-1][2] == 3
    assert spans("fixed", size=4, most_blocks=2) == [("a", 0, 4), ("a", 4, 10), ("b", 0, 3)]


def test_refinement_goes_on_until_nothing_improves(spark):
    s = seqs(spark, "ACGTACGT", "ACGAACGA", "TCGTACGA", "ACCTACGT")
    for refine in (cand.refine_greedy, cand.refine_swap, cand.refine_insertion, cand.refine_2opt):
        end = refine(s, center(spark, "TTCCAAGG"), 50)
        again = refine(s, end.select("dataset_id", "center"), 50)
        assert [r["center"] for r in again.collect()] == [r["center"] for r in end.collect()]


def test_user_metric(spark):
    from strandlake.functions.strings import register_metric, safe_json

    register_metric("First Letter", lambda a, b: (F.substring(a, 1, 1) != F.substring(b, 1, 1)).cast("int"))
    d = dist.center_distances(seqs(spark, "ACGT", "TCGT"), center(spark, "AAAA"), " first letter ")
    assert sorted(r["d"] for r in d.collect()) == [0, 1]
    texts = spark.createDataFrame([('{"a": 1}',), (" ",), ('say "x"',)], "t string")
    assert [r["j"] for r in texts.select(safe_json(F.col("t")).alias("j")).collect()] == ['{"a": 1}', None, '"say \\"x\\""']


def test_packed_distances(spark):
    from strandlake.functions.strings import hamming, hamming_of, packed

    texts = ["", "A", "ACGTACG", "ACGTACGT", "ACGTTCGA", "ACGTACGTACGTACGTACGT", "TCGTACGTACGTACGTACGA", "Äbc", "Abc", "\x00\x7f ", "\x7f\x00 ", None]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = rows.select(hamming(a, b).alias("x"), hamming_of(a, b, packed(a), packed(b)).alias("y")).collect()
    assert all(r["x"] == r["y"] for r in got) and any(r["x"] == 2 for r in got)


def test_neighbours_are_given_once(spark):
    import itertools
    import random

    rnd = random.Random(7)
    base = ["".join(rnd.choice("ACGT") for _ in range(24)) for _ in range(12)]
    texts = [b if k == 0 else "".join(rnd.choice("ACGT") if rnd.random() < 0.08 else c for c in b) for b in base for k in range(12)] + ["AC", "AG", "CGT", "", "ÄÖÜ", "ÄÖU"]
    got = sorted((r["i"], r["j"], r["d"]) for r in dist.neighbours(seqs(spark, *texts), 4).collect() if r["d"] > 0)
    want = sorted((i, j, d) for (i, x), (j, y) in itertools.combinations(enumerate(texts), 2) if len(x) == len(y) and x != y and (d := sum(p != q for p, q in zip(x, y))) <= 4 and texts.index(x) == i and texts.index(y) == j)
    assert got == want and len(got) > 100


def test_climbs_end_where_nothing_is_gained(spark):
    s = seqs(spark, "ACGTACGT", "ACGAACGA", "TCGTACGA", "ACCTACGT").unionByName(seqs(spark, "AAAA", "AAAA", dataset="same"))
    begin = center(spark, "TTCCAAGG").unionByName(center(spark, "AAAT", "same"))
    for refine in (cons.hill_climb, cand.refine_greedy, cand.refine_2opt):
        end = {r["dataset_id"]: (r["center"], r["max_distance"]) for r in refine(s, begin).collect()}
        again = {r["dataset_id"]: (r["center"], r["max_distance"]) for r in refine(s, spark.createDataFrame([(k, c) for k, (c, _) in end.items()], "dataset_id string, center string")).collect()}
        assert end == again


def test_group_method_gets_its_parameters(spark):
    from strandlake.schema import RESULTS

    def constant(rows, letter, seed=0):
        import pandas as pd

        names = [f.split()[0] for f in RESULTS.split(", ")]
        row = dict.fromkeys(names) | {"dataset_id": rows.dataset_id.iloc[0], "center_string": letter * 4, "max_distance": seed}
        return pd.DataFrame([row])[names]

    try:
        exp.register_group_method("constant", constant, deterministic=False, letter="A", seed=1)
        s = seqs(spark, "ACGT", "AAAA").unionByName(seqs(spark, "TTTT", dataset="e"))
        got = lambda **p: sorted((r["dataset_id"], r["center_string"], r["max_distance"]) for r in exp.METHODS["constant"].run(s, **p).collect())
        assert got() == [("d", "AAAA", 1), ("e", "AAAA", 1)]
        assert got(letter="T", seed=7) == [("d", "TTTT", 7), ("e", "TTTT", 7)]
        assert not exp.METHODS["constant"].deterministic
    finally:
        exp.METHODS.pop("constant", None)


def test_numbers_of_a_large_dataset_come_from_several_tasks(spark):
    ids = spark.range(60_000)
    rows = ids.select(F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 60 == 2, F.lit(None).cast("string")).otherwise("cold").alias("dataset_id"), F.xxhash64("id").alias("key"), F.lit(7).alias("seq_index"))
    small = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(small, "false")  # as little data is put together otherwise
    try:
        cut, numbered = ranges(rows, "dataset_id", "key"), number(rows, "dataset_id", "key").collect()
    finally:
        spark.conf.unset(small)
    parts = cut.where("dataset_id = 'hot'").groupBy("part_no").count().collect()
    assert len(parts) > 1 and max(p["count"] for p in parts) < 30_000
    place = {}
    for g, key, no in sorted(((r["dataset_id"] or "", r["key"], r["seq_index"]) for r in numbered)):
        assert no == place.get(g, 0)
        place[g] = no + 1
    assert sum(place.values()) == 60_000 and place["hot"] == 40_000
    assert number(rows.where("false"), "dataset_id", "key").count() == 0


@pytest.mark.parametrize(("mode", "blocks", "limit"), [("per_block", 3, 5000), ("reference", 2, 5000), ("per_block", 2, 5), ("per_block", 9, 40)])
def test_recombination_takes_all_digits_in_order(spark, mode, blocks, limit):
    texts = ["ACGTACG", "TTTTCCC", "GAGAGAG"]
    given = spark.createDataFrame([("d", 10 * i, t) for i, t in enumerate(texts)] + [("e", 1, "AC"), ("f", 1, "")], "dataset_id string, cluster_id int, center string")
    got = cons.recombine(given, blocks, mode, limit).orderBy("dataset_id", "cand_no").collect()
    b = min(blocks, 7)
    ends = [i * (7 // b) + min(i, 7 % b) for i in range(b + 1)]
    cut = lambda t, i: t[ends[i] : ends[i + 1]]
    if mode == "per_block":
        want = ["".join(cut(texts[c], i) for i, c in enumerate(choice)) for choice in itertools.product(range(3), repeat=b)]
    else:
        made = ["".join(cut(texts[c], i) for c, i in enumerate(choice)) for choice in itertools.product(range(b), repeat=3)]
        want = [(m + texts[0][len(m) :])[:7] for m in made]
    assert [r["candidate"] for r in got if r["dataset_id"] == "d"] == want[:limit]
    assert {r["candidate"] for r in got if r["dataset_id"] == "e"} <= {"AC", "A", "C", "AA", "CC", "CA"}
    assert all(r["dataset_id"] != "f" for r in got)


def test_beam_equals_a_plain_search(spark):
    rng = random.Random(5)
    rows = ["".join(rng.choice("ACG") for _ in range(11)) for _ in range(90)]
    data = seqs(spark, *rows, *rows[:30])
    spans = spark.createDataFrame([("d", 0, 0, 7), ("d", 1, 7, 10), ("d", 2, 10, 11)], "dataset_id string, block_no int, l int, r int")
    got = {(r["block_no"], r["cand_no"]): (r["candidate"], r["d"]) for r in cons.beam_blocks(data, spans, "ACG", 4, 3).collect()}
    want = {}
    for no, l, r in ((0, 0, 7), (1, 7, 10), (2, 10, 11)):
        segs = {s[l:r] for s in rows}
        miss = lambda p: max(sum(x != y for x, y in zip(p, s)) for s in segs)  # noqa: B023, E731
        beam = [""]
        for _ in range(r - l):
            beam = sorted((p + c for p in beam for c in "ACG"), key=lambda p: (miss(p), p))[:4]
        want |= {(no, i): (p, miss(p)) for i, p in enumerate(beam[:3])}
    assert got == want
    assert cons.beam_blocks(data.where("false"), spans, "ACG").count() == 0


def test_best_by_bounds_scores_few_and_finds_the_same(spark):
    rng = random.Random(9)
    letter = lambda: rng.choice("ACGT")
    base = ["".join(letter() for _ in range(30)) for _ in range(2)]
    # "near" holds rows around two bases at many distances, "noise" random ones, "odd" unequal lengths and copies
    near = ["".join(x if rng.random() > k / 400 else letter() for x in base[k % 2]) for k in range(300)]
    noise = ["".join(letter() for _ in range(30)) for _ in range(60)]
    odd = ["ACGT", "ACGT", "AC", "ACGA", ""]
    rows = [(n, i, s) for n, group in (("near", near), ("noise", noise), ("odd", odd)) for i, s in enumerate(group)]
    data = spark.createDataFrame(rows, "dataset_id string, seq_index int, sequence string")
    asked = data.select("dataset_id", F.col("seq_index").alias("cand_no"), F.col("sequence").alias("candidate"))
    asked = asked.unionByName(spark.createDataFrame([("without rows", 0, "ACGT")], asked.schema))
    got = {r["dataset_id"]: r for r in cons.best_by_bounds(data, asked, first=8).collect()}
    want = {r["dataset_id"]: r for r in cons.best_candidate(cons.score_candidates(data, asked)).collect()}
    assert {k: (r["center"], r["max_distance"]) for k, r in got.items()} == {k: (r["center"], r["max_distance"]) for k, r in want.items()}
    assert got["near"]["scored"] < 100 and got["noise"]["scored"] <= 60
    assert cons.best_by_bounds(data, asked.where("false")).count() == 0
    assert cons.best_by_bounds(data.where("false"), asked).count() == 0


def test_moves_that_far_rows_rule_out_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    data = seqs(spark, *["".join(rng.choice("AACGT") for _ in range(9)) for _ in range(150)])
    start = center(spark, "TTTCGAAAC")
    plain = cand.refine_swap(data, start, 3).first()
    monkeypatch.setattr(cand, "FAR_ROWS", 2)
    assert cand.refine_swap(data, start, 3).first() == plain
    monkeypatch.setattr(cand, "FAR_ROWS", 150)
    assert cand.refine_swap(data, start, 3).first() == plain


def _brute(pairs_of):
    return sorted((i, j, sum(x != y for x, y in zip(a, b)) if len(a) == len(b) else None) for i, a, j, b in pairs_of)


@pytest.mark.parametrize("length", [0, 1, 8, 33, 70, 300])
def test_tiles_give_what_single_comparisons_give(spark, monkeypatch, length):
    """Several blocks of a dataset, texts of other lengths, nulls, signs of more than one plane and word."""
    from strandlake.operators import tiles

    monkeypatch.setattr(tiles, "TILE", 16)
    monkeypatch.setattr(tiles, "HELD", 64)
    rng = random.Random(length)
    texts = ["".join(rng.choice("ACGTé字\U0001f600") for _ in range(length)) for _ in range(40)]
    texts += [texts[3], "A" * (length + 1), "C" * (length + 1), None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("dataset_id", F.lit("x"))
    every = [(i, a, j, b) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j]
    known = _brute(x for x in every if None not in x)
    got = [(r["i"], r["j"], r["d"]) for r in tiles.pairs(rows).collect()]
    assert sorted(got, key=str) == sorted(known + [(i, j, None) for i, a, j, b in every if None in (a, b)], key=str)
    limit = length // 2
    assert sorted((r["i"], r["j"], r["d"]) for r in tiles.pairs(rows, limit).collect()) == [k for k in known if k[2] is not None and k[2] <= limit]
    ends = [k[2] for k in known if k[2] is not None]
    assert [(r["lo"], r["hi"]) for r in tiles.extremes(rows).collect()] == [(min(ends), max(ends))]
    asked = rows.select("dataset_id", "text").distinct().where("length(text) <> 1 OR text = 'A'")
    far = {r["text"]: (r["d"], r["far"]) for r in tiles.farthest(asked, rows.where("id % 2 = 0").select("dataset_id", "text")).collect()}
    for r in asked.where("text IS NOT NULL").collect():
        ds = [sum(x != y for x, y in zip(r["text"], t)) for t in texts[::2] if t is not None and len(t) == len(r["text"])]
        d, row = far[r["text"]]
        assert d == (max(ds) if ds else None) and (row is None if not ds else sum(x != y for x, y in zip(r["text"], row)) == d)


def test_specs_of_many_rows_are_made_by_many_tasks(spark):
    spec = [("a", 5000, 6, 1, "substitution,deletion"), ("b", 3, 6, 2, "insertion")]
    df = spark.createDataFrame(spec, "dataset_id string, n int, length int, seed long, mutation_types string").coalesce(1)
    for make in (synthetic.random_sequences, synthetic.mutated_sequences, synthetic.clustered_sequences):
        assert sorted((r["dataset_id"], r["n"], r["most"]) for r in make(df).groupBy("dataset_id").agg(F.count_distinct("seq_index").alias("n"), F.max("seq_index").alias("most")).collect()) == [("a", 5000, 4999), ("b", 3, 2)]
    made = synthetic.random_sequences(df)
    assert made.where("dataset_id = 'a'").select(F.spark_partition_id()).distinct().count() > 1


def _clusters_brute(texts, radius, least):
    """Cluster of each row by the definition: core rows by weight, components, others to the smallest one they touch."""
    from itertools import count

    near = [[j for j, t in enumerate(texts) if len(t) == len(s) and sum(x != y for x, y in zip(s, t)) <= radius] for s in texts]
    core = {i for i, js in enumerate(near) if len(js) >= least}
    root = {}
    for i in sorted(core):
        todo = [i] if i not in root else []
        while todo:
            k = todo.pop()
            if k not in root:
                root[k] = i
                todo += [j for j in near[k] if j in core]
    for i, js in enumerate(near):
        if i not in core and any(j in core for j in js):
            root[i] = min(root[j] for j in js if j in core)
    number = count()
    names = {}
    return {i: names[root[i]] if root[i] in names else names.setdefault(root[i], next(number)) for i in sorted(root)}


@pytest.mark.parametrize("length, least", [(9, 2), (9, 6), (40, 6)])
def test_clusters_in_tiles_and_bands(spark, monkeypatch, length, least):
    """Short rows meet in tiles, long ones in bands; copies, rows that are not core, and rows between two clusters."""
    from strandlake.operators import tiles

    monkeypatch.setattr(tiles, "TILE", 16)
    monkeypatch.setattr(tiles, "HELD", 64)
    rng = random.Random(length + least)
    texts = ["".join(rng.choice("AC") for _ in range(9)) + "G" * (length - 9) for _ in range(70)]
    texts += [texts[3], texts[3], "T" * length, "T" * length, "A" * (length + 1)]
    got = {r["seq_index"]: r["cluster_id"] for r in cons.clusters(seqs(spark, *texts), 2, least).collect()}
    assert got == _clusters_brute(texts, 2, least)


@pytest.mark.parametrize("length", [8, 70])
def test_a_block_that_meets_itself_compares_its_pairs_once(monkeypatch, length):
    from strandlake.operators import tiles

    monkeypatch.setattr(tiles, "HELD", 1024)
    rng = random.Random(length)
    texts = ["".join(rng.choice("ACGT") for _ in range(length)) for _ in range(256)]
    found, compared = {}, 0
    for a, b, d in tiles.distances(texts, texts, own=True):
        compared += d.size
        at, to = tiles._near(d, length // 2)
        found |= {(int(i), int(j)): int(n) for i, j, n in zip(a[at], b[to], d[at, to]) if i < j}
    every = {(i, j): sum(x != y for x, y in zip(texts[i], texts[j])) for i in range(256) for j in range(i + 1, 256)}
    assert found == {k: n for k, n in every.items() if n <= length // 2}
    assert compared <= 0.55 * 256**2


@pytest.mark.parametrize("length, least", [(9, 2), (40, 2), (9, 1)])
def test_clusters_of_two_samples_compare_rows_once(spark, monkeypatch, length, least):
    from strandlake.operators import tiles

    monkeypatch.setattr(tiles, "TILE", 16)
    compared = []
    monkeypatch.setattr(tiles, "_compared", lambda *of, fn=tiles._compared: compared.append(1) or fn(*of))
    rng = random.Random(length)
    texts = ["".join(rng.choice("ACGT") for _ in range(9)) + "G" * (length - 9) for _ in range(60)]
    texts += [texts[3], "T" * length, "T" * length, "A" * (length + 1)]
    got = {r["seq_index"]: r["cluster_id"] for r in cons.clusters(seqs(spark, *texts), 2, least).collect()}
    assert got == _clusters_brute(texts, 2, least) and len(compared) == 1


def test_a_large_group_of_near_rows_gives_no_table_of_its_pairs(spark, monkeypatch):
    from strandlake.operators import distance, tiles

    monkeypatch.setattr(tiles, "TILE", 64)
    written = {}

    def kept(df, name, stage=cons.stage):
        out = stage(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(cons, "stage", kept)
    monkeypatch.setattr(distance, "stage", kept)
    texts = [f"{i:08b}".replace("0", "A").replace("1", "C") + "G" * 8 for i in range(256)]
    assert {r["cluster_id"] for r in cons.clusters(seqs(spark, *texts), 8).collect()} == {0}
    assert max(written.values()) <= 256 * 4 * 2  # a link a row and tile; there are 32,640 pairs


def test_all_pairs_of_short_texts_are_joined_by_spark(spark, monkeypatch):
    """Several blocks, unequal lengths, equal ids; a dataset with a sign beyond ASCII, a null or a long text goes by Python."""
    from strandlake.operators import tiles

    monkeypatch.setattr(tiles, "JOINED", 8)
    rng = random.Random(4)
    plain = ["".join(rng.choice("ACGT\x7f") for _ in range(n)) for n in [10] * 25 + [7, 7, 0, 0, 3]]
    sets = {"plain": plain, "other": ["é" + t for t in plain[:5]], "null": [*plain[:4], None], "long": [t * 12 for t in plain[:4]]}
    rows = spark.createDataFrame([(d, i, t) for d, ts in sets.items() for i, t in enumerate(ts)] + [("plain", 3, "A" * 10)], "dataset_id string, seq_index int, sequence string")
    known = []
    for name, ts in sets.items():
        every = [*enumerate(ts), *([(3, "A" * 10)] if name == "plain" else [])]
        known += [(name, i, j, sum(x != y for x, y in zip(a, b)) if None not in (a, b) and len(a) == len(b) else None) for i, a in every for j, b in every if i < j]
    assert sorted(map(tuple, dist.pair_table(rows).collect()), key=str) == sorted(known, key=str)
    plan = dist.pair_table(rows.where("dataset_id = 'plain'"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_moves_read_the_rows_once(spark, monkeypatch):
    """Copies are left out when the rows are written; later steps read what was written, and write it no more."""
    read, written = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    for module in (cons, cand):
        monkeypatch.setattr(module, "stage", lambda df, name, stage=module.stage: written.append((name, out := stage(df, name))) or out)
    rng = random.Random(11)
    texts = ["".join(rng.choice("ACGT") for _ in range(8)) for _ in range(90)]
    texts += texts[:30]
    rows = seqs(spark, *texts)
    start = texts[0]
    got = cand.refine_insertion(rows.mapInArrow(counted, rows.schema), center(spark, start)).collect()
    far = lambda c: max(sum(x != y for x, y in zip(c, t)) for t in texts)
    moved = [start[:i] + start[i + n :] for n in (1, 2, 3) for i in range(9 - n)]
    cuts = [start[i : i + n] for n in (1, 2, 3) for i in range(9 - n)]
    best = min(far(rest[:t] + cut + rest[t:]) for rest, cut in zip(moved, cuts) for t in range(len(rest) + 1))
    assert [r["max_distance"] for r in got] == [min(best, far(start))]
    assert read.value == len(texts)
    assert [df.count() for name, df in written if name == "rows" and df.count() > 64] == [len(set(texts))]


def test_climbs_need_no_numbers_of_rows(spark):
    """Letters carry their row's distance; joined to it by number, rows of one number or of none gave wrong steps."""
    numbered = seqs(spark, "CCCCCC", "CCCCGC", "CCACCC", "CCCCCT")
    for no in (F.col("seq_index"), F.lit(0), F.lit(None).cast("int")):
        got = cons.hill_climb(numbered.withColumn("seq_index", no), center(spark, "AAAAAA")).first()
        assert (got["center"], got["max_distance"]) == ("CCACAA", 3)


@pytest.mark.parametrize("length", [12, 40])
def test_near_pairs_have_all_copies(spark, monkeypatch, length):
    from strandlake.operators import tiles

    monkeypatch.setattr(tiles, "JOINED", 5)
    rng = random.Random(length)
    base = ["".join(rng.choice("ACGT") for _ in range(length)) for _ in range(4)]
    texts = [b if k % 3 else b[:k] + rng.choice("ACGT") + b[k + 1 :] for k in range(9) for b in base] + ["AC", "AC", "", "", "ÄÖ"] + [base[0]] * 20
    got = [(r["i"], r["j"], r["d"]) for r in dist.near_pairs(seqs(spark, *texts), 3).collect()]
    want = [(i, j, d) for (i, x), (j, y) in itertools.combinations(enumerate(texts), 2) if len(x) == len(y) and (d := sum(p != q for p, q in zip(x, y))) <= 3]
    assert sorted(got) == sorted(want) and sum(d == 0 for *_, d in want) > 300
    assert dist.near_pairs(seqs(spark, *texts).where("false"), 3).count() == 0


@pytest.mark.parametrize("few", [0, 40, 1 << 16])
def test_pairs_of_a_beginning_and_an_end_are_barred_by_rows(monkeypatch, few):
    from strandlake.operators import tiles

    monkeypatch.setattr(tiles, "FEW", few)
    rng = random.Random(few)
    text = lambda n, p: "".join(rng.choice("ACGT") if rng.random() < p else "A" for _ in range(n))
    far = lambda s, t: sum(x != y for x, y in zip(s, t))
    for left, right, p in ((5, 6, 1.0), (3, 80, 0.3), (0, 9, 0.5), (70, 2, 0.6)):
        lefts, rights = (list(dict.fromkeys(text(n, p) for _ in range(m))) for n, m in ((left, 30), (right, 75)))
        rows = [text(left + right, p) for _ in range(50)]
        worst = {(max(far(a + b, r) for r in rows), i, j) for i, a in enumerate(lefts) for j, b in enumerate(rights)}
        least = min(worst)
        for most in (least[0] - 1, least[0], least[0] + 3, left + right, -1):
            held = tiles._Joined(lefts, rights, most)
            for at in range(0, 50, 20):
                if not held.over:
                    held.show([r[:left] for r in rows[at : at + 20]], [r[left:] for r in rows[at : at + 20]])
            assert held.best() == (least if least[0] <= most else None)


@pytest.mark.parametrize("blocks", [1, 2, 3])
def test_all_recombined_candidates_are_searched(spark, monkeypatch, blocks):
    from strandlake.operators import tiles

    monkeypatch.setattr(cons, "MAX_CANDIDATES", 7)
    monkeypatch.setattr(tiles, "LEFTS", 8)
    monkeypatch.setattr(tiles, "RIGHTS", 16)
    rng = random.Random(blocks)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    centers = [("d", i, text(9)) for i in range(15)] + [("odd", i, text(n)) for i, n in enumerate([7, 7, 2, 9, 1, 7, 12, 7, 7, 8, 0, 7])] + [("few", i, text(5)) for i in range(2)] + [("none", i, text(6)) for i in range(9)]
    rows = [(d, i, text(n)) for d, n in (("d", 9), ("odd", 7), ("few", 5), ("none", 4)) for i in range(40)] + [("odd", 99, "AC")]
    data = spark.createDataFrame(rows, "dataset_id string, seq_index int, sequence string")
    given = spark.createDataFrame(centers, "dataset_id string, cluster_id int, center string")
    got = {r["dataset_id"]: (r["center"], r["max_distance"]) for r in cons.best_recombined(data, given, blocks).collect()}
    want = {r["dataset_id"]: (r["center"], r["max_distance"]) for r in cons.best_candidate(cons.score_candidates(data, cons.recombine(given, blocks, limit=100_000))).collect()}
    capped = {r["dataset_id"]: (r["center"], r["max_distance"]) for r in cons.best_recombined(data, given, blocks, limit=7).collect()}
    assert got == want and len(want) == 4
    assert capped != want


def test_clusters_beyond_five_thousand_choices_are_recombined(spark):
    """Of 81 x 81 candidates one of those behind the first 5,000 is the best."""
    rng = random.Random(81)
    pairs = ["".join(rng.choice("CGT") for _ in range(24)) for _ in range(80)]
    rows = [p for p in pairs for _ in range(2)] + ["A" * 24] * 2
    data = seqs(spark, *rows)
    made = cons.recombine(cons.cluster_consensus(data, cons.clusters(data, 1)), limit=10_000)
    want = cons.best_candidate(cons.score_candidates(data, made)).first()
    got = cons.cluster_recombine(data, 1, rounds=0).first()
    assert (got["center"], got["max_distance"]) == (want["center"], want["max_distance"])
    assert made.where("cand_no >= 5000").where(F.col("candidate") == want["center"]).count() == 1
