import hashlib
import random
import re

import pytest
from lawfinder.llm import secrets
from lawfinder.llm.secrets import PIECES, ordinary_pieces, redacted, with_spans, written
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
SCHEMA = "doc_id long, text string, spans_x string, n_chars long"


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def texts():
    rng = random.Random(3)
    digits = lambda n, alphabet: "".join(rng.choice(alphabet) for _ in range(n))
    hexa = "0123456789abcdef"
    return [
        None, "", "nothing here", 'é𝄞 token = "' + digits(40, hexa) + '" end', "PassWord:abc password:abcdef PASSWD='x.y-z_9'",
        "AKIA" + digits(16, "ABCDEFGH234") + " AKIAAKIA" + digits(12, "QRST1") + " AKIA" + digits(15, "ABC"),
        digits(24, hexa) + " " + digits(23, hexa) + "g" + digits(30, hexa), "token=token=abcdefg api_key:: apikey: 'secretsecret'",
        " ".join('secret="' + digits(12, hexa) + '"' for _ in range(700)), "tokentoken=" + digits(50, hexa), "word " * 40000 + "token: abcdefgh",
        "\n".join(digits(30, hexa) for _ in range(3)), "secret = KKey tokenſ=abcdef",
    ]


def test_base_spans_equal_brute_force(spark):
    rows = [(i, t, "x", len(t or "")) for i, t in enumerate(texts() * 2)]
    found = with_spans(spark.createDataFrame(rows, SCHEMA)).select("doc_id", written(F.col("base")).alias("b")).collect()
    assert {r["doc_id"]: r["b"] for r in found} == {i: brute(t) for i, t, *_ in rows}


def test_random_strings_are_added_and_words_are_not(spark):
    rng = random.Random(8)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    good = [(i, "see " + "".join(rng.choice(b64) for _ in range(44)) + " now", "x", 0) for i in range(150)]
    plain = [(1000 + i, f"file_name_of_the_report_version_{i}_draft and internationalization-guidelines-{i}", "x", 0) for i in range(150)]
    found = with_spans(spark.createDataFrame(good + plain, SCHEMA)).select("doc_id", F.size("spans").alias("n")).collect()
    assert sum(r["n"] > 0 for r in found if r["doc_id"] < 1000) > 130
    assert sum(r["n"] > 0 for r in found if r["doc_id"] >= 1000) < 10


ALPHABETS = {
    "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "digits": "0123456789", "letters": "abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}


def test_strings_of_each_encoding_are_found_at_a_stated_rate(spark):
    """90 of 100 random strings of each encoding, beside twice as many ordinary ones, of which 1 in 20 may be called random."""
    rng = random.Random(9)
    words = ["report", "version", "index", "draft", "archive", "photo", "summary", "internal", "update", "meeting", "final", "holiday", "customer", "notes"]
    rows, kinds = [], {}
    for name, alphabet in ALPHABETS.items():
        for _ in range(100):
            kinds[len(rows)] = name
            rows.append("see " + "".join(rng.choice(alphabet) for _ in range(rng.choice([22, 40, 64]))) + " now")
    for _ in range(1400):
        kinds[len(rows)] = "plain"
        rows.append("see " + rng.choice("-_/").join(rng.choice(words) for _ in range(rng.choice([4, 6, 9]))) + rng.choice(["", "2024", "-1"]) + " now")
    frame = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(rows)], SCHEMA)
    found = {}
    for r in with_spans(frame).select("doc_id", F.size("spans").alias("n")).collect():
        found.setdefault(kinds[r["doc_id"]], []).append(r["n"] > 0)
    assert sum(found.pop("plain")) <= 35
    assert {k: sum(v) >= 90 for k, v in found.items()} == dict.fromkeys(ALPHABETS, True), {k: sum(v) for k, v in found.items()}


def test_secrets_in_base_spans_do_not_move_the_cut(spark):
    from lawfinder.llm.secrets import length_cuts

    rng = random.Random(10)
    plain = [(i, f"the {'-'.join(rng.choice(['alpha', 'beta', 'gamma', 'delta']) for _ in range(5))} file", "x", 0) for i in range(200)]
    secret = [(900 + i, "token = " + "".join(rng.choice(ALPHABETS["base64"]) for _ in range(40)), "x", 0) for i in range(400)]
    assert length_cuts(spark.createDataFrame(plain, SCHEMA)) == length_cuts(spark.createDataFrame(plain + secret, SCHEMA))


def syllables(rng, least):
    out = ""
    while len(out) < least:
        out += rng.choice(["ver", "keit", "lich", "schen", "ung", "ein", "ab", "ge", "heit", "tag", "zu", "pf", "ro", "mi", "le", "wand", "burg", "ste", "no", "ka"])
    return out


def prose(rng):
    return " ".join(syllables(rng, rng.choice([2, 4, 7])) for _ in range(60))


@pytest.mark.parametrize("copies", [1, 20])
def test_few_long_words_are_not_random(spark, copies):
    """None of 30 long words of a corpus is called random, alone or beside random strings, and copies of documents change nothing."""
    rng = random.Random(12)
    words = [syllables(rng, 20) for _ in range(30)]
    plain = [f"{prose(rng)} {words[i] if i < 30 else ''} {prose(rng)}" for i in range(400)]
    keys = ["".join(rng.choice(ALPHABETS["base64"]) for _ in range(40)) for _ in range(40)]
    rows = [(i, t, "x", 0) for i, t in enumerate((plain[:30] * copies) + plain[30:])]
    alone = with_spans(spark.createDataFrame(rows, SCHEMA)).where(F.size("spans") > 0)
    assert alone.count() == 0
    mixed = [(10**6 + i, f"{prose(rng)} {k} {prose(rng)}", "x", 0) for i, k in enumerate(keys)]
    hits = with_spans(spark.createDataFrame(rows + mixed, SCHEMA)).select(F.explode("spans.hit").alias("hit")).collect()
    called = {r["hit"] for r in hits}
    assert not called & set(words) and len(called & set(keys)) >= 36


def test_one_random_string_in_a_corpus_is_found(spark):
    rng = random.Random(13)
    key = "".join(rng.choice(ALPHABETS["base64"]) for _ in range(44))
    rows = [(i, prose(rng) + (f" {key} " if i == 7 else " ") + prose(rng), "x", 0) for i in range(300)]
    hits = with_spans(spark.createDataFrame(rows, SCHEMA)).select("doc_id", F.explode("spans.hit").alias("hit")).collect()
    assert [tuple(r) for r in hits] == [(7, key)]


def test_ordinary_pieces(spark):
    key = "Qw9" * 20
    text = f"Aé-b {key} token='abc!def' " + "xyz " * 5000
    found = spark.createDataFrame([(text,), ("",), ("short words",)], "t string").select(ordinary_pieces(F.col("t")).alias("p")).collect()
    assert [len(r["p"]) for r in found] == [16, 0, 0]
    letters = "Abdef" + "xyz" * 5000
    want = [letters[o + a : o + a + n] for o in range(0, 4 * 4096, 4096) for a, n in zip((0, 20, 52, 100), (20, 32, 48, 96), strict=True)]
    assert found[0]["p"] == [w for w in want if w]


def test_thresholds_read_the_whole_ordinary_text(spark):
    rng = random.Random(17)
    text = " ".join("".join(rng.choice(ALPHABETS["lower"] if "lower" in ALPHABETS else "abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(1500))
    letters = text.replace(" ", "")
    found = spark.createDataFrame([(text,)], "t string").select(ordinary_pieces(F.col("t"), sum(PIECES)).alias("p")).first()["p"]
    assert "".join(found) == letters[: len("".join(found))] and len(letters) - len("".join(found)) < PIECES[0]
    seen = []
    real = secrets.ordinary_pieces
    secrets.ordinary_pieces = lambda t, *stride: seen.append(stride) or real(t, *stride)
    try:
        secrets.length_cuts(spark.createDataFrame([(text,)], "text string"))
    finally:
        secrets.ordinary_pieces = real
    assert seen == [(sum(PIECES),)]


def test_tests_that_end_early_give_the_same_bins(spark):
    rng = random.Random(19)
    strings = ["".join(rng.choice(a) for _ in range(n)) for a in ALPHABETS.values() for n in (20, 40, 90)] + [prose(rng).replace(" ", "")[:n] for n in (20, 32, 48, 96) for _ in range(10)]
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    for r in df.select(secrets.randomness(F.col("s")).alias("a"), secrets.randomness(F.col("s"), whole=False).alias("b")).collect():
        assert r["a"] == r["b"] or (r["b"] == 0 and r["a"] < 1 / secrets.BINS)


def test_candidates_clear_of_many_base_spans(spark):
    rng = random.Random(11)
    parts = []
    for _ in range(700):
        key = "".join(rng.choice(ALPHABETS["base64"]) for _ in range(30))
        parts.append(rng.choice([f"token={key}", key, f"pass {key}", f"{key}token: {key[:8]}", "0123456789abcdef" * 2 + "G" * 20]))
    text = " ".join(parts)
    row = with_spans(spark.createDataFrame([(1, text, "x", 0)], SCHEMA)).select("base", "spans").first()
    base = [(s["start"], s["end"]) for s in row["base"]]
    more = [(s["start"], s["end"]) for s in row["spans"] if s["rank"] == 3]
    assert more and all(e <= a or s >= b for s, e in more for a, b in base)
    tested = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text)]
    tested = [(s, e) for s, e in tested if all(e <= a or s >= b for a, b in base)]
    assert set(more) <= set(tested) and len(more) > 0.8 * sum("G" * 20 not in text[s:e] for s, e in tested)
    masked = redacted(spark.createDataFrame([(1, text, "x", 0)], SCHEMA)).first()["text"]
    want, at = [], 0
    for s, e in sorted(base + more):
        if s >= at:
            want += [text[at:s], "<SECRET>"]
        at = max(at, e)
    assert masked == "".join(want) + text[at:]


def test_redaction(spark):
    rows = [(0, 'a 𝄞 token = "0123456789abcdef0123456789abcdef" b', "x", 5), (1, "plain", "x", 5), (2, None, "x", None)]
    found = {r["doc_id"]: r for r in redacted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[0]["text"] == 'a 𝄞 <SECRET>" b' and found[0]["n_chars"] == len('a 𝄞 <SECRET>" b')
    assert found[1]["text"] == "plain" and found[2]["text"] is None


def test_digest_and_empty_table(spark, tmp_path):
    from lawfinder.llm.secrets import op7_secret_scans

    frame = spark.createDataFrame([(1, texts()[3], "x", 1), (2, None, "x", 1)], SCHEMA)
    frame.write.parquet(f"{tmp_path}/a/documents.parquet")
    frame.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    found = {r["doc_id"]: r for r in op7_secret_scans(spark, f"{tmp_path}/a").collect()}
    assert found[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and found[2]["spans"] == ""
    assert found[1]["base_sha256"] == hashlib.sha256(brute(texts()[3]).encode()).hexdigest()
    assert (found[1]["n_assign"], found[1]["n_access"], found[1]["n_hex"]) == (1, 0, 1)
    assert op7_secret_scans(spark, f"{tmp_path}/b").count() == 0


def mixed_strings(rng):
    """Random, ordinary and half ordinary strings of every encoding, with padding."""
    out = [prose(rng).replace(" ", "")[:n] for n in PIECES for _ in range(40)]
    out += [s.upper() for s in out[::4]] + [s.title() for s in out[::3]]
    out += ["".join(c.upper() if rng.random() < 0.3 else c for c in s) for s in out[:120]]
    out += ["".join(rng.choice(a) for _ in range(n)) for a in ALPHABETS.values() for n in PIECES for _ in range(8)]
    return out + [s + "=" for s in out[::5]] + ["=" * 20, "a=b" * 9, "A+/-_=" * 8]


def test_strings_are_tested_once_and_no_longer_than_their_bin_needs(spark):
    """Bins and encodings are those of all tests; what lies under the lowest cut mostly ends early, and kinds are counted in one pass."""
    strings = mixed_strings(random.Random(23))
    s = F.col("s")
    given = spark.createDataFrame([(x,) for x in strings], "s string").withColumn("e", secrets.encoding(s))
    rows = given.select("s", "e", secrets.randomness(s).alias("a"), secrets.randomness(s, whole=False).alias("b"), secrets.randomness(s, whole=False, own=F.col("e")).alias("c")).collect()
    assert [r["e"] for r in rows] == [next(k for k, (p, _) in enumerate(secrets.ENCODINGS) if re.search(p, r["s"].rstrip("="))) for r in rows]
    assert all(r["b"] == r["c"] and int(r["a"] * secrets.BINS) == int(r["b"] * secrets.BINS) for r in rows)
    low = [r for r in rows if r["a"] < 1 / secrets.BINS]
    assert len(low) > 200 and sum(r["b"] > 0 for r in low) <= 0.1 * len(low)
    assert str(secrets.randomness(s)).count("translate(") == 1


def test_scans_name_their_symbols_and_find_the_same(spark):
    rng = random.Random(29)
    symbols = "abcxyzABCXYZ0189+/_=-  .,:;é𝄞\n@[`{"
    texts = ["".join(rng.choice(symbols[: rng.choice([18, 24, len(symbols)])]) for _ in range(300)) for _ in range(60)] + ["x" * 19, "x" * 20, "token: abc " + "y" * 30]
    t = F.col("t")
    frame = spark.createDataFrame([(x,) for x in texts], "t string")
    for r in frame.select("t", ordinary_pieces(t, sum(PIECES)).alias("p"), secrets.matches(t, secrets.CANDIDATE, "random").alias("m")).collect():
        assert [(m["start"], m["end"]) for m in r["m"]] == [m.span() for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", r["t"])]
        plain = re.sub(r"[A-Za-z0-9+/_=-]{20,}|[^A-Za-z0-9]+", "", ASSIGN.sub(" ", r["t"]))
        assert "".join(r["p"]) == plain[: len("".join(r["p"]))] and len(plain) - len("".join(r["p"])) < PIECES[0]
    # a negated class of ranges took Java eight times as long over whole texts
    assert "[^A-Z" not in str(ordinary_pieces(t)) and "[^a-z" not in str(ordinary_pieces(t)) and "A-Z" not in secrets.CANDIDATE
