"""Quality, URL, PII and fingerprint operators against plain Python."""

import hashlib
import math
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from gazeframe.llm import fingerprint, private, quality, queries, urls

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def h(data, seed=42):
    """Spark's hash of a string or of a long, as a signed number."""
    raw = data.encode() if isinstance(data, str) else (data % (1 << 64)).to_bytes(8, "little")
    value = xxhash.xxh64_intdigest(raw, seed % (1 << 64))
    return value - (1 << 64) if value >= 1 << 63 else value


def base(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(inside),
    )


def test_quality_against_brute_force(spark):
    made = {r.doc_id: r for r in queries.QUERIES["op1_quality"](spark, SF).collect()}
    docs = documents(spark)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {d for d, r in labels.items() if r.quality == 1 and not r.toxic}
    raw, target, grams = Counter(), Counter(), {}
    for doc, text in docs:
        words = WORD.findall(text)
        single = [h(w) for w in words]
        found = single + [h(b, h(a)) for a, b in zip(single, single[1:])]
        grams[doc] = [g % quality.BUCKETS for g in found]
        raw.update(grams[doc])
        if doc in good:
            target.update(grams[doc])
    n, t = sum(raw.values()), sum(target.values())
    for doc, text in docs:
        r = made[doc]
        counts = base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        ratio = [
            math.log((target[g] + quality.PRIOR) / (raw[g] * t / n + quality.PRIOR))
            for g in grams[doc]
        ]
        llr = sum(ratio) / max(1, len(ratio))
        assert abs(r.llr - llr) < 1e-9
        assert r.base_failed == failed and r.kept == (not failed and llr >= -0.05)


def test_quality_keeps_good_and_rejects_bad(spark):
    sf = "/root/testdata/sf0.01"
    made = queries.QUERIES["op1_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    share = {(r.quality, r.toxic): r.kept for r in made.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1, 0] > 0.93 and share[0, 0] < 0.1


def test_quality_keeps_good_documents_of_every_language(spark):
    """By language with all labels, and with 50 and 400 of them against ten times as many documents."""
    for sf, most, least in (("sf0.01", 20_000, 0.9), ("sf0.1", 50, 0.9), ("sf0.1", 400, 0.9)):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
        made = quality.assess(docs, labels, trusted_rows=most).select("doc_id", "lang", "base_failed", "kept")
        good = made.where("NOT base_failed").join(labels.where("quality = 1 AND toxic = 0"), "doc_id")
        share = {r.lang: r.kept for r in good.groupBy("lang").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
        assert len(share) == 4 and min(share.values()) >= least


def test_ngrams_without_evidence_are_neutral(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, "some other rare words"), (3, None)], "doc_id long, text string")
    trusted = docs.where("doc_id = 1").select("doc_id", F.lit(1).alias("trusted"))
    for rows in (trusted, trusted.limit(0)):
        weights = quality.log_ratios(docs, rows).first().w
        assert max(map(abs, weights)) < 0.15 and sum(w == 0 for w in weights) >= quality.BUCKETS - 13


def test_fingerprints_against_brute_force(spark):
    made = {r.doc_id: r for r in queries.QUERIES["op9_fingerprints"](spark, SF).collect()}
    docs = sorted(documents(spark))

    def sketch(text):
        # Runs of 1, 2, 4 and 5 words are joined in turn, as hashes.
        w = [h(x) for x in WORD.findall(text.lower())]
        if not w:
            return []
        if len(w) < 5:
            seed = 42
            for x in w:
                seed = h(x, seed)
            return [seed]
        two = [h(b, h(a)) for a, b in zip(w, w[1:])]
        four = [h(b, h(a)) for a, b in zip(two, two[2:])]
        five = [h(b, h(a)) for a, b in zip(four, four[1:])]
        low = sorted({x for x in five if x < fingerprint.limit_of(1 / 8)})
        return low or [min(five)]

    def alike(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0

    for i, (doc, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edit = text[: len(text) - half] + following[:half]
        r = made[doc]
        a, b, c = sketch(text), sketch(edit), sketch(following)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert r.fingerprint == ",".join(f"{x % (1 << 64):016x}" for x in a)
        assert r.edited_fingerprint == ",".join(f"{x % (1 << 64):016x}" for x in b)
        assert abs(r.near_edited - alike(a, b)) < 1e-12 and abs(r.near_next - alike(a, c)) < 1e-12


def test_sketches_merge(spark):
    text = [" ".join(f"a{i}" for i in range(3000)), " ".join(f"a{i}" for i in range(1000))]
    df = spark.createDataFrame([tuple(text)], "x string, y string")
    x, y = fingerprint.sketch(F.col("x")), fingerprint.sketch(F.col("y"))
    r = df.select(
        fingerprint.containment(y, x).alias("whole"), fingerprint.containment(x, y).alias("part"), fingerprint.merged(x, y).alias("m"), x.alias("x")
    ).first()
    assert r.whole == 1.0 and abs(r.part - 1 / 3) < 0.08 and r.m == r.x


def pseudonyms(spark, values, key="k"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    return [r.text for r in private.protect(df, key).orderBy("i").collect()]


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_pseudonyms_keep_formats(spark):
    old = ["4041894974608795", "4041 8949 7460 8795", "+1 (988) 555-2485", "152.143.123.131", "123-45-6789", "DE89 3704 0044 0532 0130 00", "2024-02-29", "31/12/1999", "a.b@c.example.com"]
    new = pseudonyms(spark, old)
    assert all(a != b for a, b in zip(old, new))
    assert luhn(new[0]) and new[1].replace(" ", "") == new[0] and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", new[1])
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", new[2])
    assert all(int(p) < 256 for p in new[3].split(".")) and re.fullmatch(r"\d{3}-\d{2}-\d{4}", new[4])
    number = new[5].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1
    assert re.fullmatch(r"\d{4}-\d{2}-\d{2}", new[6]) and re.fullmatch(r"\d{2}/\d{2}/\d{4}", new[7])
    assert new == pseudonyms(spark, old) and new != pseudonyms(spark, old, "other")


def test_pseudonyms_leave_what_is_not_valid(spark):
    old = ["4041894974608796", "300.1.1.1", "666-45-6789", "2023-02-29", "plain 12 words 3.5", "version 1.2.3", "", None]
    assert pseudonyms(spark, old) == old


def test_pseudonyms_inside_text(spark):
    one = 'Call +1 (988) 555-2485, or write to x.y@mail.example.com; token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end.'
    new = pseudonyms(spark, [one])[0]
    assert "555-2485" not in new and "x.y@" not in new and "24be64" not in new
    assert new.startswith("Call +1 (") and new.endswith('" end.') and " or write to " in new


def test_feistel_is_a_permutation(spark):
    low, high = private.DAY_HALVES
    df = spark.range(low * high).select(private.feistel(F.floor(F.col("id") / high), F.col("id") % high, (low, high), "k", "date").alias("m"))
    r = df.select((F.col("m.a") * high + F.col("m.b")).alias("x")).agg(F.countDistinct("x"), F.min("x"), F.max("x")).first()
    assert tuple(r) == (low * high, 0, low * high - 1)


def test_urls(spark):
    cases = [
        ("https://A.Example.NET/en/1?x=/fr/", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("https://example.net/fr/", "example.net", "/fr/", "net/", "block"),
        ("http://www.example.com/de/5", "www.example.com", "/de/5", "example.com/de/", "block"),
        ("http://notexample.com/de/5", "notexample.com", "/de/5", None, "allow"),
        ("http://x.org/fr/#a", "x.org", "/fr/", "org/fr/", "allow"),
        ("http://x.net", "x.net", "", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("http://cheap-pills.example.org/en/9", "cheap-pills.example.org", "/en/9", None, "block"),
        ("http://www.casino-win.example.com/en/3", "www.casino-win.example.com", "/en/3", None, "block"),
        ("http://blog.thehouse.example.com/en/3", "blog.thehouse.example.com", "/en/3", None, "allow"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id int, url string")
    made = {r.page_id: r for r in urls.judge(df, urls.labelled_urls(spark)).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        r = made[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or verdict is None and r.verdict in ("allow", "block")


def test_url_model_learns_its_table(spark):
    table = urls.labelled_urls(spark)
    made = urls.judge(table, table, rules=())
    assert made.where((F.col("verdict") == "block") != (F.col("blocked") == 1)).count() == 0
