"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline
from textquarry.llm import catalog


def corpus(spark, folder):
    r = random.Random(11)
    vocabulary = ["".join(r.choices("abcdefghilmnoprstu", k=r.randint(3, 8))) for _ in range(400)]
    text = lambda n: " ".join(w + "." if r.random() < 0.1 else w for w in r.choices(vocabulary, k=n)).replace(". ", ".\n", 2)
    rows = [(i, text(120), "en", f"s{i % 3}") for i in range(80)]
    item, line = text(30), " ".join(r.choices(vocabulary, k=12))
    rows += [(100 + i, "#%&@" * 80 + "".join(r.choices("#%&@XYZ!", k=200)), "en", "s0") for i in range(3)]
    rows += [(200 + i, rows[0][1] + f" tail{i}", "en", "s1") for i in range(4)]
    rows += [(300, f"{text(50)} {item} {text(50)}", "en", "s2")]
    rows += [(400 + i, f"{text(60)}\n{line}\n{text(60)}", "en", None) for i in range(12)]
    spark.createDataFrame([(*x, len(x[1])) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return line


def test_stages(spark, tmp_path):
    line = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append({x.doc_id: x for x in docs.collect()})
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    every = {*range(80), *range(200, 204), 300, *range(400, 412)}
    assert set(seen[0]) == every
    assert set(seen[1]) == every and [i for i, x in seen[1].items() if line in x.text.split("\n")] == [400]
    assert all(x.n_chars == len(x.text) for x in seen[1].values())
    assert set(seen[2]) == every - {200, 201, 202, 203}
    assert set(seen[3]) == set(seen[2]) - {300}
    assert set(seen[4]) <= set(seen[3]) and all(x.copies in (1, 2) and x.taken == x.copies * x.size for x in seen[4].values())


def test_catalog():
    names = list(catalog.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def awkward_rows():
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(n))
    shared = prose(9)
    rows = [(i, f"{prose(60)}\n{shared}\n{prose(5)}", "en", "s", 1) for i in range(11)] + [(20 + i, prose(80), None, None, 1) for i in range(8)]
    rows += [(40, None, "en", "s", None), (41, "", "en", "s", 0), (None, rows[0][1], None, None, 1), (None, rows[0][1], None, None, 1), (None, None, None, None, None), (50, "\n".join(prose(12) for _ in range(3000)), "de", "t", 1)]
    rows += [rows[14], rows[14], (23, prose(70), "en", "s", 1)]
    return [(*x, 7, 8, 9, 10, "l", 12, "g") for x in rows]


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, repeats, shared ids and clashing names, against rules told plainly; and empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, copies int, taken long, target long, n_lines string, n_dropped long, __group string"
    rows = awkward_rows()
    docs = spark.createDataFrame(rows, schema)
    item = " ".join(rows[18][1].split()[10:40])
    spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = {n: lambda d=docs, f=f: f(spark, d, str(tmp_path)) for n, f in corpus_pipeline.STAGES}
    have = lambda df: sorted(((x.doc_id, x.text) for x in df.collect()), key=repr)
    every = sorted(((x[0], x[1]) for x in rows), key=repr)
    good = have(stage["quality classifier"]())
    assert [x for x in every if x[0] is None or not x[1]] == [x for x in good if x[0] is None or not x[1]]
    lines = stage["line dedup"]()
    assert lines.columns == docs.columns and {(x.n_lines, x.n_dropped) for x in lines.collect()} == {("l", 12)}
    shared = rows[0][1].split("\n")[1]
    expected = [(i, t if not t or i == 0 or shared not in t else "\n".join(x for x in t.split("\n") if x != shared)) for i, t in every]
    assert have(lines) == sorted(expected, key=repr)
    near = have(stage["MinHash near-dedup"]())
    assert {i for i, _ in near} == {None, *range(11), *range(20, 28), 40, 50}
    assert sum(i is None for i, _ in near) == 3 and len({i for i, _ in near if i is not None}) == len([i for i, _ in near if i is not None])
    clean = have(stage["benchmark decontamination"]())
    assert clean == [x for x in every if x[0] != rows[18][0]]
    mixed = stage["mixing sources to target weights"]().collect()
    assert mixed and all(x.text and x.copies in (1, 2) and x.taken == x.copies * x.size == x.copies * len(x.text.split()) for x in mixed)
    for name, _ in corpus_pipeline.STAGES:
        assert stage[name](docs.limit(0)).collect() == []
