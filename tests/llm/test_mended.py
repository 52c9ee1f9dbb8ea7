"""Cases that once went wrong: skewed mixtures, stray quotes, account numbers before capitals, texts of very many lines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import html, linededup, mixing, pseudonyms

# ------------------------------------------------------------------ 1


def dual_rates(n, p, goal, ridge):
    """The rates from the multipliers of the domains, by damped Newton steps on a system of their number."""
    lam = np.zeros(p.shape[1])

    def at(lam):
        r = np.maximum(0, 1 - p @ lam / ridge)
        return r, (n * r) @ p - goal - goal * lam

    for _ in range(500):
        r, g = at(lam)
        if np.abs(g / goal).max() < 1e-12:
            break
        on = n * (r > 0)
        step, size = np.linalg.solve((p * on[:, None]).T @ p / ridge + np.diag(goal), g), 1.0
        value = lambda x: goal @ (x * x) / 2 + goal @ x + ridge / 2 * (n * np.maximum(0, 1 - p @ x / ridge) ** 2).sum()
        while value(lam + size * step) > value(lam) and size > 1e-9:
            size /= 2
        lam = lam + size * step
    return at(lam)[0]


@pytest.mark.parametrize("share", [(0.02, 0.94, 0.04), (0.6, 0.3, 0.1)])
def test_rates_meet_targets_of_skewed_corpora(spark, share):
    rng = np.random.default_rng(1)
    domain = rng.choice(3, 3000, p=share)
    score = rng.normal(0, 1, (3000, 3)) + 8 * np.eye(3)[domain]
    p = np.exp(score) / np.exp(score).sum(1, keepdims=True)
    n = rng.integers(1, 400, 3000)
    goal = 1.1 * (n @ p)[0] / 0.93 * np.array([0.93, 0.05, 0.02])
    members = spark.createDataFrame([(i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(n, p))], "id long, n long, p array<double>")
    errors, scale, left = mixing._fit(members, list(goal), mixing.RIDGE, None, mixing.TOLERANCE)
    r = mixing._fold(p, errors, scale, mixing.RIDGE)[0]
    assert np.abs(left).max() <= mixing.TOLERANCE and np.allclose((n * r) @ p, goal * (1 + left))
    best = dual_rates(n.astype(float), p, goal, mixing.RIDGE)
    assert np.allclose((n * best) @ p, goal, rtol=2e-3) and (r >= 0).all()


def test_targets_out_of_reach_are_reported(spark):
    members = spark.createDataFrame([(i, 10, [0.8, 0.2, 0.0]) for i in range(50)], "id long, n long, p array<double>")
    _, _, left = mixing._fit(members, [300.0, 20.0, 10.0], mixing.RIDGE, None, mixing.TOLERANCE)
    assert left[2] == pytest.approx(-1) and abs(left).max() > 0.5


# ------------------------------------------------------------------ 2


def test_account_numbers_before_capitals(spark):
    texts = ["BE68 5390 0754 7034 CALL me", "BE68539007547034 US now", "ES91 2100 0418 4502 0005 1332 BIC", "NO93 8601 1117 947 OK", "GB82 WEST 1234 5698 7654 32", "mail a@" + "b." * 100 + "example.org now", "ring +49 (0)30 1234567 or"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in pseudonyms.pseudonymise(df).orderBy("doc_id").collect()]
    for old, new, tail in zip(texts, got, ("CALL me", "US now", "BIC", "OK", "32"[:0], "now", "or")):
        assert new != old and new.endswith(tail), new
    for new, digits in zip(got, (16, 16, 24, 15, 22)):
        number = new.replace(" ", "")[:digits]
        assert int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1
    assert "b.b." not in got[5].split("@")[0] and "@pseudonym.invalid" in got[5] and got[6].startswith("ring +49 (0)")


# ------------------------------------------------------------------ 5


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>Before <a title=it's>link</a> Some text. They don't know.</p><p>More</p>", "Before link Some text. They don't know.\n\nMore"),
        ("<p data-h=5'>A first paragraph.</p><p>Second one isn't lost?</p><p>Third</p>", "A first paragraph.\n\nSecond one isn't lost?\n\nThird"),
        ("<p title=\"a > b\">one</p><p title='c > \"d'>two</p>", "one\n\ntwo"),
        ('<p a="never closed>one</p><p>two</p>', "one\n\ntwo"),
        ('<p a = "x>y" "stray">one</p><p b=\'z\'c="w">two</p>', "one\n\ntwo"),
    ],
)
def test_stray_quotes_lose_no_text(spark, page, want):
    pages = spark.createDataFrame([(1, "http://h/1", page)], "page_id long, url string, html string")
    assert html.extract(pages).first()["text"] == want


# ------------------------------------------------------------------ 6


def test_a_text_of_very_many_lines(spark):
    n = 150_000
    first = "\n".join(f"A line with the number {i} that stays where it is, {i * i}." for i in range(3))
    many = "\n".join(["This line stands here over and over again.", "And this one does so as well, now and then."] * n)
    df = spark.createDataFrame([(1, first), (2, many), (3, first)], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.dedup_lines(df).collect()}
    assert got[1] == (first, 3, 0) and got[3] == ("", 3, 3)
    assert got[2] == ("This line stands here over and over again.\nAnd this one does so as well, now and then.", 2 * n, 2 * n - 2)


def test_stretches_between_dropped_lines(spark):
    df = spark.createDataFrame([([0], "a"), ([0, 1], "a\nb"), ([1], "a\nb\nc"), ([0, 2], "a\nb\nc"), ([2], "a\nb\nc"), ([1, 2], "a\nb\nc\n")], "drop array<int>, t string")
    got = [r["k"] for r in df.select(F.array_join(linededup._between(F.split("t", "\n", -1), "drop"), "|").alias("k")).collect()]
    assert got == ["", "", "a|c", "b", "a|b", "a|"]


# ------------------------------------------------------------------ 7


def test_a_cluster_without_a_key_gets_its_own(spark, monkeypatch):
    class Cluster:
        master = "spark://head:7077"
        getConf = dict

    class Session:
        sparkContext, conf = Cluster, {}

    with pytest.warns(UserWarning, match="pseudonym.key"):
        key = pseudonyms.key_of(Session)
    assert len(key) == 64 and key != pseudonyms.DEMO_KEY and key == pseudonyms.key_of(Session)
    monkeypatch.setattr(Session, "conf", {pseudonyms.KEY_SETTING: "given"})
    assert pseudonyms.key_of(Session) == "given"
    assert pseudonyms.key_of(spark) == pseudonyms.DEMO_KEY
