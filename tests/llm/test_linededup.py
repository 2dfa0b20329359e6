import random

from lawfinder.llm.linededup import GRAM, REACH, deduplicated

SCHEMA = "doc_id long, text string, deleted long, first string"


def corpus():
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(2000)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [[line(60)], [line(9) for _ in range(8)], [line(25), "", line(30)], [line(4)], [line(200)], [line(20), line(20), line(20), line(20)]]
    docs = []
    for i in range(120):
        parts = [line(rng.choice([3, 12, 40])) for _ in range(rng.choice([1, 4, 9]))]
        if i % 3 == 0:
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = rng.choice(shared)
        docs.append("\n".join(parts))
    docs += [docs[7]] * 40 + [None, "", "\n\n", "single", "\n".join(shared[0] * 30), "\n".join(f"{line(30)}" for _ in range(1500))]
    docs.append(docs[-1])
    return [(i, t, i, "x") for i, t in enumerate(docs)]


def units(text):
    return [(p, x) for p, x in enumerate(text.split("\n")) if x.split()] if text else []


def covered(rows, least):
    """Lines that lie in a run of at least ``least`` words equal to one that starts earlier."""
    own = {i: units(t) for i, t, *_ in rows}
    where = {}
    for i in sorted(own):
        for k, (_, x) in enumerate(own[i]):
            where.setdefault(x, []).append((i, k))
    out = {i: set() for i in own}
    for i, lines in own.items():
        for k, (_, x) in enumerate(lines):
            for j, m in where[x]:
                if (j, m) >= (i, k):
                    break
                n = 0
                while k + n < len(lines) and m + n < len(own[j]) and lines[k + n][1] == own[j][m + n][1]:
                    n += 1
                if sum(len(lines[k + d][1].split()) for d in range(n)) >= least:
                    out[i].update(lines[k + d][0] for d in range(n))
    return out


def test_against_brute_force(spark):
    rows = corpus()
    found = {r["doc_id"]: r for r in deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(found) == len(rows)
    must, may = covered(rows, REACH), covered(rows, GRAM)
    for i, text, *_ in rows:
        gone = set(found[i]["deleted_lines"])
        kept = {p for p, _ in units(text)}
        assert must[i] <= gone, i
        assert gone & kept <= may[i], i
        if text:
            assert found[i]["text"] == "\n".join(x for p, x in enumerate(text.split("\n")) if p not in gone)
        else:
            assert found[i]["text"] == text
        assert all(s <= i for s in found[i]["source_ids"]) and bool(gone) == bool(found[i]["source_ids"])


def test_empty_table_and_repeated_rows(spark):
    assert deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "\n".join(["a b c d e f g h i j k l m n"] * 2)
    found = deduplicated(spark.createDataFrame([(1, text, 0, "x")] * 3, SCHEMA)).collect()
    assert [r["deleted_lines"] for r in found] == [[1]] * 3


def test_parts_that_stand_alone_earlier(spark):
    rng = random.Random(12)
    line = lambda n: " ".join(f"v{rng.randrange(2000)}" for _ in range(n))
    rows = []
    for i in range(0, 240, 4):
        passage = [line(12) for _ in range(6)]
        alone = [[line(20), passage[k], line(20)] for k in (1, 4)]
        holders = [[line(20), *passage, line(20)] for _ in range(2)]
        rows += [(i + k, "\n".join(x), 0, "x") for k, x in enumerate(alone + holders)]
    found = {r["doc_id"]: set(r["deleted_lines"]) for r in deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    must, may = covered(rows, REACH), covered(rows, GRAM)
    assert all(must[i] <= found[i] <= may[i] for i in must) and sum(map(len, must.values())) == 60 * 6


def test_short_lines_after_a_long_one(spark):
    rng = random.Random(13)
    line = lambda n: " ".join(f"v{rng.randrange(2000)}" for _ in range(n))
    rows = []
    for i in range(0, 120, 2):
        passage = [[line(60), line(5)], [line(60), *(line(10) for _ in range(4))], [line(5), line(70), "", line(3)]][i // 2 % 3]
        rows += [(i + k, "\n".join([line(20), *passage, line(20)]), 0, "x") for k in range(2)]
    found = {r["doc_id"]: set(r["deleted_lines"]) for r in deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    must, own = covered(rows, REACH), {i: {p for p, _ in units(t)} for i, t, *_ in rows}
    assert all(found[i] & own[i] == must[i] for i in must) and sum(map(len, must.values())) == 20 * (2 + 5 + 3)


def test_column_clashes_and_missing_ids(spark):
    text = "\n".join(" ".join(f"w{i}_{k}" for k in range(20)) for i in range(4))
    rows = [(None, text, "a", [9], [1]), (1, text, "d", None, None), (2, text, "b", None, None), (None, None, "c", None, None)]
    schema = "doc_id long, text string, text_hash string, deleted_lines array<int>, source_ids array<long>"
    found = {r["text_hash"]: r for r in deduplicated(spark.createDataFrame(rows, schema)).collect()}
    assert found["a"]["text"] == text and found["a"]["deleted_lines"] == []
    assert found["b"]["text"] == "" and found["b"]["deleted_lines"] == [0, 1, 2, 3]
    assert found["c"]["text"] is None and found["d"]["text"] == text and len(found) == 4
