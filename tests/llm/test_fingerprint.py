import hashlib
import random

from pyspark.sql import functions as F

from columnaut.llm import fingerprint as P


def brute(docs):
    rows = [(r.doc_id, r.text) for r in sorted(docs.withColumn("p", F.monotonically_increasing_id()).collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.p))]
    out = []
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 4
        e = t[: len(t) - k] + nxt[:k]
        f = P.fingerprint(t)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), f, P.fingerprint(e), P.likeness(f, P.fingerprint(e)), P.likeness(f, P.fingerprint(nxt))))
    return out


def random_rows():
    rng = random.Random(4)
    return [(rng.randrange(-(10**6), 10**9), "".join(rng.choice("abc dé\nxyz") for _ in range(rng.randrange(0, 400)))) for _ in range(300)]


def test_edited_equals_brute_force(spark):
    rows = random_rows() + [(5, None), (6, ""), (7, "z" * 300_000), (8, "same"), (8, "same"), (8, "other"), (None, "null id"), (-(2**63), "least id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as place", "2 as part", "3 as range").repartition(7)
    want = brute(docs)
    for least, size in ((1, 1 << 30), (5, 1 << 30), (1, 20_000)):
        got = [tuple(r) for r in P.edited_likeness(docs, least_ranges=least, range_bytes=size).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert P.edited_likeness(docs.limit(0)).count() == 0
    own = {(r.doc_id, r.n_chars, r.fingerprint) for r in P.fingerprints(docs).collect()}
    assert own == {(d, n, f) for d, n, _, f, *_ in want}
    one = P.edited_likeness(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_ids_may_be_strings(spark):
    docs = spark.createDataFrame([(str(i) if i % 50 else None, t) for i, t in random_rows()], "doc_id string, text string").repartition(3)
    got = [tuple(r) for r in P.edited_likeness(docs, least_ranges=4).collect()]
    assert sorted(got, key=str) == sorted(brute(docs), key=str)


def test_hot_ids_are_cut_into_parts(spark, tmp_path):
    """A third of the rows have one id and another third have none: each row still has one next row, all in one circle, in the order of the ids."""
    rows = [(None if i % 3 == 0 else 77 if i % 3 == 1 else i, f"{i:04d}" * 4) for i in range(360)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    dealt = P.in_order(docs, "doc_id", "text", least_ranges=12)
    sizes = [r["count"] for r in dealt.where("not copy").groupBy("range").count().collect()]
    assert sum(sizes) == 360 and max(sizes) < 70
    edit = {hashlib.sha256((f"{i:04d}" * 3 + f"{j:04d}").encode()).hexdigest(): (i, j) for i in range(360) for j in range(360)}
    after = dict(edit[r.edited_sha256] for r in P.edited_likeness(docs, least_ranges=12).collect())
    order, i = [], 0
    while i not in order:
        order.append(i)
        i = after[i]
    assert len(order) == 360
    ids = [rows[i][0] if rows[i][0] is not None else -1 for i in order]
    start = next(k for k in range(360) if ids[k] == -1 and ids[k - 1] != -1)
    assert ids[start:] + ids[:start] == sorted(ids)


def test_likeness():
    a, b = "the quick brown fox " * 40, "entirely different words here " * 30
    assert P.likeness(P.fingerprint(a), P.fingerprint(a)) == 1
    assert 0 <= P.likeness(P.fingerprint(a), P.fingerprint(b)) < P.likeness(P.fingerprint(a), P.fingerprint(a + "end")) <= 1
    assert P.likeness(P.fingerprint(""), P.fingerprint("")) == 1
    assert P.fingerprint("ab") != P.fingerprint("ba")


def test_long_texts_are_counted_across_slabs():
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(3 * P._SLAB // 2))
    whole, P._SLAB = P._counts(text.encode()), 1 << 22
    try:
        assert (P._counts(text.encode()) == whole).all()
    finally:
        P._SLAB = 1 << 20
