"""Registered queries on sequence tables, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.strings import hamming, levenshtein, unit
from ..operators import candidates as cand
from ..operators import consensus as cons
from ..operators import distance as dist
from ..operators import profile as prof
from ..sources import synthetic as syn
from ..sources.datasets import load_datasets
from .views import Views

DNA = "ACGT"
RADIUS = 13


def _centers_of(v: Views):
    return cons.greedy_consensus(v.dna)


def _specs(v: Views, **more):
    """A dataset spec for each nation: sizes and seeds come from the table."""
    n = F.col("n_nationkey")
    rows = v.table("customer").groupBy("c_nationkey").count().join(v.table("nation"), F.col("c_nationkey") == n)
    cols = {"dataset_id": F.col("n_name"), "n": F.col("count").cast("int"), "length": (10 + n).cast("int"), "alphabet": F.lit(DNA), "seed": n}
    return rows.select(*[c.alias(k) for k, c in (cols | {k: F.lit(x) for k, x in more.items()}).items()])


_SPEC = "spec AS (SELECT n_name AS dataset_id, count(*) AS n, 10 + n_nationkey AS length, n_nationkey AS seed FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), rows_ AS (SELECT spec.*, i AS seq_index FROM spec, range(100000) t(i) WHERE i < n)"


def _u(*keys: str) -> str:
    return "(('0x' || substr(md5(" + " || '|' || ".join(keys) + "), 1, 8))::BIGINT / 4294967296.0)"


def _letter(*keys: str) -> str:
    return f"substr('ACGT', 1 + floor({_u(*keys)} * 4)::INT, 1)"


_COUNTS = "counts AS (SELECT dataset_id, pos, ch, count(*) AS cnt, min(seq_index) AS first_seen FROM dchars GROUP BY ALL)"
_TOP = "(SELECT dataset_id, pos, ch, row_number() OVER (PARTITION BY dataset_id, pos ORDER BY cnt DESC, {tie}) AS r FROM counts) WHERE r = 1"
_JOINED = "SELECT dataset_id, string_agg(ch, '' ORDER BY pos) AS center FROM "
_LEX = f"{_COUNTS}, lexc AS ({_JOINED}{_TOP.format(tie='ch')} GROUP BY dataset_id)"
_SEEN = f"{_COUNTS}, seenc AS ({_JOINED}{_TOP.format(tie='first_seen')} GROUP BY dataset_id)"
_DIV = "SELECT dataset_id, CASE WHEN count(*) = 0 THEN 0 ELSE sum(d) / count(*) / 32 END AS diversity FROM pairs GROUP BY dataset_id"
_SPANS = "spans AS (SELECT dataset_id, b AS block_no, b * 8 AS l, (b + 1) * 8 AS r FROM (SELECT DISTINCT dataset_id FROM dna), range(4) t(b)), segs AS (SELECT d.dataset_id, seq_index, block_no, l, r, substr(sequence, l::INT + 1, 8) AS seg FROM dna d JOIN spans USING (dataset_id))"
_REACH = f"""near AS (SELECT dataset_id, i, j FROM pairs WHERE d <= {RADIUS}), nb AS (SELECT dataset_id, i, j FROM near UNION SELECT dataset_id, j, i FROM near),
 reach(dataset_id, i, j) AS (SELECT dataset_id, i, i FROM nb UNION SELECT r.dataset_id, r.i, b.j FROM reach r JOIN nb b ON r.dataset_id = b.dataset_id AND r.j = b.i),
 roots AS (SELECT dataset_id, i AS seq_index, min(j) AS root FROM reach GROUP BY ALL),
 clus AS (SELECT dataset_id, seq_index, dense_rank() OVER (PARTITION BY dataset_id ORDER BY root) - 1 AS cluster_id FROM roots)"""


def _lengths(v: Views):
    return v.dna.groupBy("dataset_id").agg(F.min(F.char_length("sequence")).alias("length"))


def _spans(v: Views):
    return prof.block_spans(_lengths(v), "even", blocks=4)


def _cands(v: Views):
    return v.dna.select("dataset_id", F.col("seq_index").alias("cand_id"), F.col("sequence").alias("candidate"))


def _pick(n: str, *keys: str) -> str:
    return f"floor({_u(*keys)} * {n})::INT"


_C = "(SELECT dataset_id, seq_index AS cand_id, sequence AS c FROM dna)"
_I = _pick("32", "'0'", "'a'", "dataset_id", "cand_id")
_J = _pick("32", "'0'", "'b'", "dataset_id", "cand_id")
_STRETCH = f"st AS (SELECT *, least({_I}, {_J}) AS i, greatest({_I}, {_J}) AS j FROM {_C})"
_COUPLES = "numbered AS (SELECT dataset_id, sequence AS c, row_number() OVER (PARTITION BY dataset_id ORDER BY seq_index) - 1 AS no FROM dna), couples AS (SELECT x.dataset_id, x.no // 2 AS pair, x.c AS a, y.c AS b FROM numbered x JOIN numbered y ON x.dataset_id = y.dataset_id AND x.no % 2 = 0 AND y.no = x.no + 1)"


def _both(one: str, two: str, frm: str = "couples") -> str:
    return f"SELECT dataset_id, pair * 2 AS cand_id, {one} AS candidate FROM {frm} UNION ALL SELECT dataset_id, pair * 2 + 1, {two} FROM {frm}"


def _substituted(c: str, k: int) -> str:
    """``c`` with a hashed letter at its k-th hashed place, other than the one there."""
    at = _pick("32", "'0'", "'p'", "dataset_id", "cand_id", f"'{k}'")
    rest = f"replace('ACGT', substr({c}, {at} + 1, 1), '')"
    return f"substr({c}, 1, {at}) || substr({rest}, {_pick('3', chr(39) + '0' + chr(39), chr(39) + 's' + chr(39), 'dataset_id', 'cand_id', chr(39) + str(k) + chr(39))} + 1, 1) || substr({c}, {at} + 2)"


def _improved(moves: str) -> str:
    """The best of one round of ``moves(dataset_id, no, nc)``, if it is better than the centre."""
    return f"WITH mv AS ({moves}), ms AS (SELECT mv.dataset_id, no, nc, max(hamming(nc, sequence)) AS m FROM mv JOIN dna USING (dataset_id) GROUP BY ALL), mb AS (SELECT * FROM ms QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY m, no) = 1), nw AS (SELECT dataset_id, center, max(d) AS m0 FROM dist GROUP BY ALL) SELECT dataset_id, CASE WHEN m < m0 THEN nc ELSE center END AS center, least(m, m0) AS max_distance FROM nw JOIN mb USING (dataset_id)"


def _beam_sql(depth: int, width: int, k: int) -> str:
    """A beam search as one step a position: prefixes of the block's segments, the best go on."""
    worst = "max(hamming({p}, substr(seg, 1, {n})))"
    by = "row_number() OVER (PARTITION BY dataset_id, block_no ORDER BY {worst}, {p})"
    heads = [f"WITH {_SPANS}, sg AS (SELECT DISTINCT dataset_id, block_no, seg FROM segs), al AS (SELECT unnest(['A','C','G','T']) AS x), b0 AS (SELECT DISTINCT dataset_id, block_no, '' AS p FROM sg)"]
    for n in range(1, depth + 1):
        rank = by.format(worst=worst.format(p="p || x", n=n), p="p || x")
        heads.append(f"b{n} AS (SELECT dataset_id, block_no, p || x AS p FROM b{n - 1} JOIN sg USING (dataset_id, block_no), al GROUP BY dataset_id, block_no, p, x QUALIFY {rank} <= {width})")
    last = worst.format(p="p", n=depth)
    return ", ".join(heads) + f" SELECT dataset_id, block_no, p AS candidate, {last} AS d, {by.format(worst=last, p='p')} - 1 AS cand_no FROM b{depth} JOIN sg USING (dataset_id, block_no) GROUP BY dataset_id, block_no, p QUALIFY cand_no < {k}"


def _climbed(moves: str, order: str) -> str:
    """Rounds of ``moves`` of the state st(dataset_id, center, m), ``order`` and nc, while the best one is better."""
    step = f"SELECT st.dataset_id, m, {order}, nc, max(hamming(nc, sequence)) AS ms FROM ({moves}) st JOIN dna USING (dataset_id) GROUP BY st.dataset_id, m, {order}, nc QUALIFY row_number() OVER (PARTITION BY st.dataset_id ORDER BY ms, {order}) = 1"
    return f"WITH RECURSIVE letters AS (SELECT DISTINCT dataset_id, ch AS b FROM dchars), st(dataset_id, center, m) AS (SELECT dataset_id, center, max(d) FROM dist GROUP BY ALL UNION ALL SELECT dataset_id, nc, ms FROM ({step}) WHERE ms < m) SELECT dataset_id, min_by(center, m) AS center, min(m) AS max_distance FROM st GROUP BY dataset_id"


def _loaded(v: Views):
    """A dataset for each nation, made up, and the names of one brand as an external feed."""
    made = _specs(v).select("dataset_id", F.lit(None).cast("string").alias("name"), F.lit("synthetic").alias("type"), F.create_map(*[x for k in ("n", "length", "alphabet", "seed") for x in (F.lit(k), F.col(k).cast("string"))]).alias("parameters"))
    fed = v.spark.createDataFrame([("Brand#11", "feed", "external", {"min_length": "8", "max_length": "11"})], "dataset_id string, name string, type string, parameters map<string,string>")
    return load_datasets(made.unionByName(fed), landed=v.names)[0]


QUERIES = {
    # ---- profiles
    "p1_sizes": (lambda v: prof.sizes(v.names), "SELECT dataset_id, count(*) AS size, min(length(sequence)) AS min_length, max(length(sequence)) AS max_length, avg(length(sequence)) AS avg_length, sum(length(sequence))::BIGINT AS total_chars FROM names GROUP BY dataset_id"),
    "p2_uniformity": (lambda v: prof.uniformity(v.names, with_lengths=True).withColumn("lengths", F.array_join("lengths", ",")), "SELECT dataset_id, count(DISTINCT length(sequence)) = 1 AS uniform, string_agg(length(sequence), ',' ORDER BY seq_index) AS lengths FROM names GROUP BY dataset_id"),
    "p3_alphabets": (lambda v: prof.alphabets(v.names), "SELECT dataset_id, string_agg(ch, '' ORDER BY ch) AS alphabet, count(*) AS alphabet_size FROM (SELECT DISTINCT dataset_id, ch FROM nchars) GROUP BY dataset_id"),
    "p4_foreign": (lambda v: prof.foreign(v.names, "abcdefghijklmnopqrst "), "SELECT * FROM names WHERE translate(sequence, 'abcdefghijklmnopqrst ', '') <> ''"),
    "p5_diversity": (lambda v: prof.diversity(v.dna), _DIV),
    "p5_pair_counts": (lambda v: prof.pair_counts(v.days).select("dataset_id", "size", "mismatches", "pairs"), "WITH c AS (SELECT dataset_id, pos, ch, count(*) AS n FROM ychars GROUP BY ALL), m AS (SELECT dataset_id, pos, sum(n) AS np, sum(n * (n - 1)) AS same FROM c GROUP BY ALL) SELECT dataset_id, max(np)::BIGINT AS size, (sum(np * (np - 1) - same) / 2)::BIGINT AS mismatches, (max(np) * (max(np) - 1) / 2)::BIGINT AS pairs FROM m GROUP BY dataset_id"),
    "p6_pattern": (lambda v: prof.with_pattern(v.dna, "A", -3), "SELECT * FROM dna WHERE substr(sequence, 30, 1) = 'A'"),
    "p7_remove": (lambda v: prof.remove(v.names, v.names.where("length(sequence) > 10").select("dataset_id", "seq_index")), "SELECT dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY seq_index) - 1 AS seq_index, sequence FROM names WHERE length(sequence) <= 10"),
    "p7_append": (lambda v: prof.append(v.names.where("length(sequence) > 10"), v.names.where("length(sequence) <= 10")), "SELECT dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY length(sequence) <= 10, seq_index) - 1 AS seq_index, sequence FROM names"),
    "p8_records": (lambda v: prof.from_records(prof.to_records(v.names)), "SELECT * FROM names"),
    "p9_preview": (lambda v: prof.preview(v.names, 5), "SELECT dataset_id, seq_index, sequence FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY seq_index) AS r FROM names) WHERE r <= 5"),
    "p10_info": (lambda v: prof.info(v.dna).select("dataset_id", "size", "total_chars", "uniform", "alphabet", "diversity", "size_kb", "kind"), f"WITH dv AS ({_DIV}) SELECT dataset_id, count(*) AS size, sum(length(sequence))::BIGINT AS total_chars, true AS uniform, 'ACGT' AS alphabet, any_value(diversity) AS diversity, sum(length(sequence)) / 1024 AS size_kb, 'dna' AS kind FROM dna JOIN dv USING (dataset_id) GROUP BY dataset_id"),
    "p11_rejected_specs": (lambda v: syn.rejected(_specs(v)).select("dataset_id", "reason"), f"WITH {_SPEC} SELECT dataset_id, concat_ws('; ', CASE WHEN n NOT BETWEEN 3 AND 1000 THEN 'n not in 3..1000' END, CASE WHEN length NOT BETWEEN 5 AND 10000 THEN 'length not in 5..10000' END) AS reason FROM spec WHERE n NOT BETWEEN 3 AND 1000 OR length NOT BETWEEN 5 AND 10000"),
    "p12_pad": (lambda v: prof.uniformise(v.names, "pad", "N"), "SELECT dataset_id, seq_index, rpad(sequence, max(length(sequence)) OVER (PARTITION BY dataset_id)::INT, 'N') AS sequence FROM names"),
    "p12_trim": (lambda v: prof.uniformise(v.names, "trim"), "SELECT dataset_id, seq_index, substr(sequence, 1, min(length(sequence)) OVER (PARTITION BY dataset_id)) AS sequence FROM names"),
    "p12_majority": (lambda v: prof.uniformise(v.names, "majority"), "WITH c AS (SELECT dataset_id, length(sequence) AS n, count(*) AS k FROM names GROUP BY ALL), t AS (SELECT dataset_id, n FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY k DESC, n) AS r FROM c) WHERE r = 1) SELECT names.* FROM names JOIN t ON names.dataset_id = t.dataset_id AND length(sequence) = n"),
    "p12_strict": (lambda v: prof.uniformise(v.days, "strict"), "SELECT * FROM days"),
    "s12_external": (lambda v: syn.external_clean(v.names, 8, 11, policy="trim"), "WITH k AS (SELECT * FROM names WHERE length(sequence) BETWEEN 8 AND 11) SELECT dataset_id, seq_index, substr(sequence, 1, min(length(sequence)) OVER (PARTITION BY dataset_id)) AS sequence FROM k"),
    "p14_spans_even": (lambda v: prof.block_spans(_lengths(v), "even", blocks=5), "SELECT dataset_id, b AS block_no, b * 6 + least(b, 2) AS l, (b + 1) * 6 + least(b + 1, 2) AS r FROM (SELECT DISTINCT dataset_id FROM dna), range(5) t(b)"),
    "p14_spans_fixed": (lambda v: prof.block_spans(_lengths(v), "fixed", size=6, least=3), "SELECT dataset_id, b AS block_no, b * 6 AS l, CASE WHEN b = 4 THEN 32 ELSE (b + 1) * 6 END AS r FROM (SELECT DISTINCT dataset_id FROM dna), range(5) t(b)"),
    "p14_spans_proportional": (lambda v: prof.block_spans(_lengths(v), "proportional", blocks=5), "SELECT dataset_id, b AS block_no, floor(b * 32 / 5)::INT AS l, floor((b + 1) * 32 / 5)::INT AS r FROM (SELECT DISTINCT dataset_id FROM dna), range(5) t(b)"),
    "p14_spans_capped": (lambda v: prof.block_spans(_lengths(v), "fixed", size=6, most_blocks=3), "SELECT dataset_id, b AS block_no, b * 6 AS l, CASE WHEN b = 2 THEN 32 ELSE (b + 1) * 6 END AS r FROM (SELECT DISTINCT dataset_id FROM dna), range(3) t(b)"),
    "p15_segments": (lambda v: prof.segments(v.dna, _spans(v)), f"WITH {_SPANS} SELECT * FROM segs"),
    "p16_repair": (lambda v: v.names.select("dataset_id", "seq_index", prof.repair_length(F.col("sequence"), F.lit(9)).alias("sequence")), "SELECT dataset_id, seq_index, rpad(substr(sequence, 1, 9), 9, right(sequence, 1)) AS sequence FROM names"),
    # ---- distances
    "d1_hamming": (lambda v: dist.center_distances(v.dna, v.centers).select("dataset_id", "seq_index", "d"), "SELECT dataset_id, seq_index, d FROM dist"),
    "d2_levenshtein": (lambda v: v.names.join(v.names.groupBy("dataset_id").agg(F.min_by("sequence", "seq_index").alias("c")), "dataset_id").select("dataset_id", "seq_index", levenshtein(F.col("c"), F.col("sequence")).alias("d")), "WITH c AS (SELECT dataset_id, min_by(sequence, seq_index) AS c FROM names GROUP BY ALL) SELECT n.dataset_id, seq_index, levenshtein(c, sequence) AS d FROM names n JOIN c USING (dataset_id)"),
    "d4_d6_summary": (lambda v: dist.summary(dist.center_distances(v.dna, v.centers), "center"), "SELECT dataset_id, center, max(d) AS max_distance, min(d) AS min_distance, avg(d) AS avg_distance, sum(d)::BIGINT AS total_distance, median(d) AS median_distance, count(*) AS num_strings FROM dist GROUP BY ALL"),
    "d8_strength": (lambda v: dist.summary(dist.center_distances(v.dna, v.centers), "center").select("dataset_id", dist.strength(F.col("max_distance"), F.col("center")).alias("strength")), "SELECT dataset_id, 1 - max(d) / 32 AS strength FROM dist GROUP BY dataset_id"),
    "d9_quality": (lambda v: dist.quality(v.dna, v.centers).select("dataset_id", "max_distance", "avg_distance", "diversity", "consensus_strength"), "WITH more AS (SELECT dataset_id, sequence AS s, seq_index AS k FROM dna UNION ALL SELECT dataset_id, center, 2147483647 FROM centers), dv AS (SELECT a.dataset_id, avg(hamming(a.s, b.s)) / 32 AS diversity FROM more a JOIN more b ON a.dataset_id = b.dataset_id AND a.k < b.k GROUP BY ALL) SELECT dataset_id, max(d) AS max_distance, avg(d) AS avg_distance, any_value(diversity) AS diversity, 1 - max(d) / 32 AS consensus_strength FROM dist JOIN dv USING (dataset_id) GROUP BY dataset_id"),
    "d10_compare": (lambda v: dist.compare(v.dna, v.centers, v.dna.groupBy("dataset_id").agg(F.max_by("sequence", "seq_index").alias("center"))).select("dataset_id", "better", "max_difference", "avg_difference"), "WITH c2 AS (SELECT dataset_id, max_by(sequence, seq_index) AS c2 FROM dna GROUP BY ALL), q AS (SELECT d.dataset_id, center, c2, max(hamming(center, sequence)) AS m1, max(hamming(c2, sequence)) AS m2, avg(hamming(center, sequence)) AS a1, avg(hamming(c2, sequence)) AS a2 FROM dna d JOIN centers USING (dataset_id) JOIN c2 USING (dataset_id) GROUP BY ALL) SELECT dataset_id, CASE WHEN m1 < m2 THEN center ELSE c2 END AS better, m1 - m2 AS max_difference, a1 - a2 AS avg_difference FROM q"),
    "d11_pairs": (lambda v: dist.pair_table(v.dna), "SELECT * FROM pairs"),
    "d12_mean_pair": (lambda v: prof.mean_pair_distance(v.dna), "SELECT dataset_id, avg(d) AS mean_distance FROM pairs GROUP BY dataset_id"),
    "d13_extremes": (lambda v: dist.pair_extremes(v.dna), "SELECT dataset_id, min(d) AS min_distance, avg(d) AS mean_distance, max(d) AS max_distance FROM pairs GROUP BY dataset_id"),
    "k2_neighbours": (lambda v: dist.near_pairs(v.dna, RADIUS), f"SELECT * FROM pairs WHERE d <= {RADIUS}"),
    # ---- consensus
    "c1_symbol_counts": (lambda v: prof.symbol_counts(v.days), "SELECT dataset_id, pos, ch, count(*) AS cnt, min(seq_index) AS first_seen FROM ychars GROUP BY ALL"),
    "c2_consensus_lex": (lambda v: cons.greedy_consensus(v.dna), f"WITH {_LEX} SELECT * FROM lexc"),
    "c2_consensus_random": (lambda v: cons.greedy_consensus(v.dna, "random", seed=3), f"WITH {_COUNTS} {_JOINED}{_TOP.format(tie=_u(chr(39) + '3' + chr(39), 'pos', 'ch'))} GROUP BY dataset_id"),
    "c3_plurality": (lambda v: cons.plurality(v.dna), f"WITH {_SEEN} SELECT * FROM seenc"),
    "c4_entropy": (lambda v: prof.entropies(v.days), "WITH c AS (SELECT dataset_id, pos, ch, count(*) AS n FROM ychars GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY dataset_id, pos) AS p FROM c) SELECT dataset_id, pos, -sum(p * log2(p)) AS entropy FROM p GROUP BY ALL"),
    "c5_entropy_spans": (lambda v: prof.entropy_spans(v.dna), "WITH RECURSIVE ec AS (SELECT dataset_id, pos, ch, count(*) AS n FROM dchars GROUP BY ALL), ep AS (SELECT *, n / sum(n) OVER (PARTITION BY dataset_id, pos) AS p FROM ec), en AS (SELECT dataset_id, pos, -sum(p * log2(p)) AS e FROM ep GROUP BY ALL), hi AS (SELECT *, e > 0.7 * max(e) OVER (PARTITION BY dataset_id) AS high FROM en), walk(dataset_id, block_no, l, r) AS (SELECT dataset_id, 0, 0, CASE WHEN high THEN 2 ELSE 4 END FROM hi WHERE pos = 0 UNION ALL SELECT w.dataset_id, w.block_no + 1, w.r, least(32, w.r + CASE WHEN high THEN 2 ELSE 4 END) FROM walk w JOIN hi ON hi.dataset_id = w.dataset_id AND hi.pos = w.r WHERE w.r < 32) SELECT dataset_id, block_no, l, r FROM walk"),
    "c6_observed": (lambda v: prof.observed_symbols(v.days), "SELECT dataset_id, pos, string_agg(ch, '' ORDER BY ch) AS symbols FROM (SELECT DISTINCT dataset_id, pos, ch FROM ychars) GROUP BY ALL"),
    "c7_difficulty": (lambda v: cons.block_difficulty(v.dna, _spans(v)).select("dataset_id", "block_no", "difficulty"), f"WITH {_SEEN}, {_SPANS} SELECT s.dataset_id, block_no, max(hamming(seg, substr(center, l::INT + 1, 8))) AS difficulty FROM segs s JOIN seenc USING (dataset_id) GROUP BY ALL"),
    "c8_tiers": (lambda v: cons.block_difficulty(v.dna, _spans(v)).select("dataset_id", "block_no", cons.technique(F.col("difficulty"), 6, 8, 7).alias("technique")), f"WITH {_SEEN}, {_SPANS}, q AS (SELECT s.dataset_id, block_no, max(hamming(seg, substr(center, l::INT + 1, 8))) AS d FROM segs s JOIN seenc USING (dataset_id) GROUP BY ALL) SELECT dataset_id, block_no, CASE WHEN d <= 6 THEN 'exhaustive' WHEN d <= 7 THEN 'reduced_beam' ELSE 'beam' END AS technique FROM q"),
    "c9_run": (lambda v: cons.results(v.dna, _centers_of(v), "consensus").drop("parameters"), f"WITH {_LEX} SELECT dataset_id, 'consensus' AS method, true AS success, center AS center_string, max(hamming(center, sequence)) AS max_distance, avg(hamming(center, sequence)) AS avg_distance, sum(hamming(center, sequence))::BIGINT AS total_distance, NULL AS error FROM dna JOIN lexc USING (dataset_id) GROUP BY dataset_id, center"),
    # ---- clusters and candidates
    "k1_auto": (lambda v: cons.auto_parameters(v.dna), "SELECT dataset_id, greatest(2, floor(avg(d) * 0.8))::INT AS d, 2 AS n_blocks, 32 AS length FROM pairs GROUP BY dataset_id"),
    "k3_clusters": (lambda v: cons.clusters(v.dna, RADIUS), f"WITH RECURSIVE {_REACH} SELECT * FROM clus"),
    "k4_cluster_consensus": (lambda v: cons.cluster_consensus(v.dna, cons.clusters(v.dna, RADIUS)), f"WITH RECURSIVE {_REACH}, cc AS (SELECT c.dataset_id, cluster_id, pos, ch, count(*) AS cnt, min(c.seq_index) AS fs FROM dchars c JOIN clus USING (dataset_id, seq_index) GROUP BY ALL) SELECT dataset_id, cluster_id, string_agg(ch, '' ORDER BY pos) AS center FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, cluster_id, pos ORDER BY cnt DESC, fs) AS r FROM cc) WHERE r = 1 GROUP BY ALL"),
    "k5_recombine": (lambda v: cons.recombine(v.dna.select("dataset_id", F.col("seq_index").alias("cluster_id"), F.col("sequence").alias("center")), 2), "SELECT a.dataset_id, (row_number() OVER (PARTITION BY a.dataset_id ORDER BY a.seq_index, b.seq_index) - 1) AS cand_no, substr(a.sequence, 1, 16) || substr(b.sequence, 17, 16) AS candidate FROM dna a JOIN dna b ON a.dataset_id = b.dataset_id QUALIFY cand_no < 5000"),
    "k6_best_candidate": (lambda v: cons.best_by_bounds(v.dna, v.dna.select("dataset_id", F.col("seq_index").alias("cand_no"), F.col("sequence").alias("candidate"))).drop("scored"), "WITH s AS (SELECT a.dataset_id, a.seq_index, a.sequence AS center, max(hamming(a.sequence, b.sequence)) AS max_distance FROM dna a JOIN dna b ON a.dataset_id = b.dataset_id GROUP BY ALL) SELECT dataset_id, center, max_distance FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY max_distance, seq_index) AS r FROM s) WHERE r = 1"),
    "k7_fallback": (lambda v: cons.with_fallback(v.dna, cons.best_recombined(v.dna, cons.cluster_consensus(v.dna, cons.clusters(v.dna, 7)), 2)).select("dataset_id", "center", "fallback_used"), None),
    "k8_cluster_recombine": (lambda v: cons.cluster_recombine(v.dna, RADIUS), None),
    "h1_exhaustive": (lambda v: cons.exhaustive_blocks(v.dna, prof.block_spans(_lengths(v), "fixed", size=4), DNA, 3), "WITH al AS (SELECT unnest(['A','C','G','T']) AS x), tx AS (SELECT a.x || b.x || c.x || d.x AS candidate FROM al a, al b, al c, al d), sg AS (SELECT DISTINCT dataset_id, b AS block_no, substr(sequence, b::INT * 4 + 1, 4) AS seg FROM dna, range(8) t(b)), sc AS (SELECT dataset_id, block_no, candidate, max(hamming(candidate, seg)) AS d FROM sg, tx GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY dataset_id, block_no ORDER BY d, candidate) - 1 AS cand_no FROM sc QUALIFY cand_no < 3"),
    "h2_beam": (lambda v: cons.beam_blocks(v.dna, prof.block_spans(_lengths(v), "fixed", size=8), DNA, 8, 3), _beam_sql(8, 8, 3)),
    "h4_block_heuristic": (lambda v: cons.block_heuristic(v.dna, DNA, width=8, k=3), None),
    "r1_hill_climb": (lambda v: cons.hill_climb(v.dna, v.centers, 1).select("dataset_id", "center", "max_distance"), "WITH alt AS (SELECT DISTINCT dataset_id, pos, ch AS b FROM dchars), mv AS (SELECT dataset_id, pos, b, center, substr(center, 1, pos::INT) || b || substr(center, pos::INT + 2) AS nc FROM centers JOIN alt USING (dataset_id) WHERE substr(center, pos::INT + 1, 1) <> b), sc AS (SELECT mv.dataset_id, pos, b, nc, max(hamming(nc, sequence)) AS d FROM mv JOIN dna USING (dataset_id) GROUP BY ALL), best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY d, pos, b) = 1), now AS (SELECT dataset_id, center, max(d) AS m FROM dist GROUP BY ALL) SELECT dataset_id, CASE WHEN d < m THEN nc ELSE center END AS center, least(d, m) AS max_distance FROM now JOIN best USING (dataset_id)"),
    "r2_greedy": (lambda v: cand.refine_greedy(v.dna, v.centers), _climbed("SELECT dataset_id, m, pos, b, substr(center, 1, pos::INT) || b || substr(center, pos::INT + 2) AS nc FROM st JOIN letters USING (dataset_id), range(32) p(pos) WHERE substr(center, pos::INT + 1, 1) <> b", "pos, b")),
    "r3_swap": (lambda v: cand.refine_swap(v.dna, v.centers), _improved("SELECT dataset_id, i * 32 + j AS no, substr(center, 1, i::INT) || substr(center, j::INT + 1, 1) || substr(center, i::INT + 2, (j - i - 1)::INT) || substr(center, i::INT + 1, 1) || substr(center, j::INT + 2) AS nc FROM centers, range(32) a(i), range(32) b(j) WHERE i < j")),
    "r5_one_reversal": (lambda v: cand.refine_2opt(v.dna, v.centers, 1), _improved("SELECT dataset_id, i * 32 + j AS no, substr(center, 1, i::INT) || reverse(substr(center, i::INT + 1, (j - i + 1)::INT)) || substr(center, j::INT + 2) AS nc FROM centers, range(32) a(i), range(32) b(j) WHERE i < j")),
    "r4_insertion": (lambda v: cand.refine_insertion(v.dna, v.centers), _improved("SELECT dataset_id, (n * 32 + i) * 33 + t AS no, substr(rest, 1, t::INT) || substr(center, i::INT + 1, n::INT) || substr(rest, t::INT + 1) AS nc FROM (SELECT dataset_id, center, n, i, substr(center, 1, i::INT) || substr(center, (i + n)::INT + 1) AS rest FROM centers, range(1, 4) x(n), range(32) y(i) WHERE i <= 32 - n), range(32) z(t) WHERE t <= 32 - n AND t <> i")),
    "r5_2opt": (lambda v: cand.refine_2opt(v.dna, v.centers), _climbed("SELECT dataset_id, m, i * 32 + j AS no, substr(center, 1, i::INT) || reverse(substr(center, i::INT + 1, (j - i + 1)::INT)) || substr(center, j::INT + 2) AS nc FROM st, range(32) a(i), range(32) b(j) WHERE i < j", "no")),
    "g1_mutate_multi": (lambda v: cand.mutate_multi(_cands(v), DNA, 2), f"WITH one AS (SELECT dataset_id, cand_id, {_substituted('c', 1)} AS c FROM {_C}) SELECT dataset_id, cand_id, {_substituted('c', 2)} AS candidate FROM one"),
    "g2_inversion": (lambda v: cand.mutate_inversion(_cands(v)), f"WITH {_STRETCH} SELECT dataset_id, cand_id, substr(c, 1, i) || reverse(substr(c, i + 1, j - i + 1)) || substr(c, j + 2) AS candidate FROM st"),
    "g3_transposition": (lambda v: cand.mutate_transposition(_cands(v)), f"WITH {_STRETCH}, rs AS (SELECT *, substr(c, 1, i) || substr(c, j + 2) AS rest FROM st), pt AS (SELECT *, floor({_u(chr(39) + '0' + chr(39), chr(39) + 't' + chr(39), 'dataset_id', 'cand_id')} * (length(rest) + 1))::INT AS p FROM rs) SELECT dataset_id, cand_id, substr(rest, 1, p) || substr(c, i + 1, j - i + 1) || substr(rest, p + 1) AS candidate FROM pt"),
    "g4_one_point": (lambda v: cand.crossover_one_point(_cands(v)), f"WITH {_COUPLES}, cut AS (SELECT *, 1 + {_pick('31', chr(39) + '0' + chr(39), 'dataset_id', 'pair')} AS p FROM couples) " + _both("substr(a, 1, p) || substr(b, p + 1)", "substr(b, 1, p) || substr(a, p + 1)", "cut")),
    "g5_uniform": (lambda v: cand.crossover_uniform(_cands(v)), f"WITH {_COUPLES}, bits AS (SELECT dataset_id, pair, a, b, i, {_u(chr(39) + '0' + chr(39), 'dataset_id', 'pair', 'i')} < 0.5 AS h FROM couples, range(32) t(i)), mix AS (SELECT dataset_id, pair, string_agg(substr(CASE WHEN h THEN a ELSE b END, i::INT + 1, 1), '' ORDER BY i) AS x, string_agg(substr(CASE WHEN h THEN b ELSE a END, i::INT + 1, 1), '' ORDER BY i) AS y FROM bits GROUP BY dataset_id, pair) " + _both("x", "y", "mix")),
    "g6_blocks": (lambda v: cand.crossover_blocks(_cands(v), _spans(v)), f"WITH {_COUPLES}, bits AS (SELECT dataset_id, pair, a, b, i, {_u(chr(39) + '0' + chr(39), 'dataset_id', 'pair', 'i')} < 0.5 AS h FROM couples, range(4) t(i)), mix AS (SELECT dataset_id, pair, string_agg(substr(CASE WHEN h THEN a ELSE b END, i::INT * 8 + 1, 8), '' ORDER BY i) AS x, string_agg(substr(CASE WHEN h THEN b ELSE a END, i::INT * 8 + 1, 8), '' ORDER BY i) AS y FROM bits GROUP BY dataset_id, pair) " + _both("x", "y", "mix")),
    "g7_pool": (lambda v: cand.pool(v.dna, _spans(v), DNA), None),
    "g8_elite": (lambda v: cand.elite(cons.score_candidates(v.dna, v.dna.select("dataset_id", F.col("seq_index").alias("cand_no"), F.col("sequence").alias("candidate")))).select("dataset_id", "cand_no", "max_d", "rank"), "WITH s AS (SELECT a.dataset_id, a.seq_index AS cand_no, max(hamming(a.sequence, b.sequence)) AS max_d FROM dna a JOIN dna b ON a.dataset_id = b.dataset_id GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY max_d, cand_no) AS rank FROM s QUALIFY rank <= greatest(1, floor(count(*) OVER (PARTITION BY dataset_id) * 0.1))"),
    "g9_niche": (lambda v: cand.niche(cons.score_candidates(v.dna, v.dna.select("dataset_id", F.col("seq_index").alias("cand_no"), F.col("sequence").alias("candidate"))), 14).select("dataset_id", "cand_no", "max_d"), None),
    "e1_upper_bound": (lambda v: cand.upper_bound(v.dna), "SELECT dataset_id, center, max(d) AS max_distance FROM dist GROUP BY ALL"),
    "e3_smallest_radius": (lambda v: cand.smallest_radius(_small(v)).select("dataset_id", "success", "radius"), "WITH seg AS (SELECT DISTINCT dataset_id || '/' || (seq_index // 4) AS dataset_id, b, substr(sequence, b::INT * 4 + 1, 4) AS s FROM dna, range(8) t(b)), al AS (SELECT unnest(['A','C','G','T']) AS x), tx AS (SELECT a.x || b.x || c.x || d.x AS c FROM al a, al b, al c, al d), sc AS (SELECT dataset_id || '/' || b AS dataset_id, c, max(hamming(c, s)) AS d FROM seg, tx GROUP BY ALL) SELECT dataset_id, true AS success, min(d) AS radius FROM sc GROUP BY dataset_id"),
    # ---- generators
    "s6_random": (lambda v: syn.random_sequences(_specs(v)), f"WITH {_SPEC} SELECT dataset_id, seq_index, string_agg({_letter('seed', chr(39) + 'r' + chr(39), 'dataset_id', 'seq_index', 'p')}, '' ORDER BY p) AS sequence FROM rows_, range(64) t(p) WHERE p < length GROUP BY ALL"),
    "s7_noise": (lambda v: syn.noisy_sequences(_specs(v, noise=0.3, base_sequence="ACGTTGCAACGT")), f"WITH {_SPEC}, ch AS (SELECT dataset_id, seq_index, p, seed, substr('ACGTTGCAACGT', p::INT + 1, 1) AS x FROM rows_, range(12) t(p)) SELECT dataset_id, seq_index, string_agg(CASE WHEN {_u('seed', chr(39) + 'n' + chr(39), 'dataset_id', 'seq_index', 'p')} < 0.3 THEN substr(replace('ACGT', x, ''), 1 + floor({_u('seed', chr(39) + 'ns' + chr(39), 'dataset_id', 'seq_index', 'p')} * 3)::INT, 1) ELSE x END, '' ORDER BY p) AS sequence FROM ch GROUP BY ALL"),
    "s8_mutations": (lambda v: syn.mutated_sequences(_specs(v, mutation_rate=0.2, mutation_types="substitution,insertion,deletion")), None),
    "s9_clustered": (lambda v: syn.clustered_sequences(_specs(v)), f"WITH {_SPEC}, ch AS (SELECT dataset_id, seq_index, p, CASE WHEN {_u('seed', chr(39) + 'cd' + chr(39), 'dataset_id', 'seq_index', 'p')} < 0.2 THEN {_letter('seed', chr(39) + 'cl' + chr(39), 'dataset_id', 'seq_index', 'p')} ELSE {_letter('seed', chr(39) + 'c' + chr(39), 'dataset_id', '(seq_index % 2)', 'p')} END AS x FROM rows_, range(64) t(p) WHERE p < length) SELECT dataset_id, seq_index, string_agg(x, '' ORDER BY p) AS sequence, seq_index % 2 AS cluster_id FROM ch GROUP BY ALL"),
    "s10_dispatch": (lambda v: syn.synthetic(_specs(v).withColumn("mode", F.get(F.array(*[F.lit(m) for m in ("random", "noise", "mutations", "clustered")]), (F.col("seed") % 4).cast("int")))), None),
    "s11_datasets": (lambda v: _loaded(v), f"WITH {_SPEC} SELECT dataset_id, seq_index, string_agg({_letter('seed', chr(39) + 'r' + chr(39), 'dataset_id', 'seq_index', 'p')}, '' ORDER BY p) AS sequence FROM rows_, range(64) t(p) WHERE p < length GROUP BY ALL UNION ALL SELECT dataset_id, seq_index, sequence FROM names WHERE dataset_id = 'Brand#11' AND length(sequence) BETWEEN 8 AND 11"),
    "hash_unit": (lambda v: v.names.select("dataset_id", "seq_index", unit(7, F.col("sequence")).alias("u")), f"SELECT dataset_id, seq_index, {_u(chr(39) + '7' + chr(39), 'sequence')} AS u FROM names"),
    "u3_metric": (lambda v: dist.center_distances(v.dna, v.centers, " Hamming ").groupBy("dataset_id").agg(F.sum("d").alias("total")), "SELECT dataset_id, sum(d)::BIGINT AS total FROM dist GROUP BY dataset_id"),
}


def _small(v: Views):
    """Blocks of four letters of four rows each: many datasets small enough for exact search."""
    spans = prof.block_spans(_lengths(v), "fixed", size=4)
    segs = prof.segments(v.dna, spans)
    name = F.concat_ws("/", "dataset_id", F.floor(F.col("seq_index") / 4).cast("string"), "block_no")
    return segs.select(name.alias("dataset_id"), "seq_index", F.col("seg").alias("sequence"))
