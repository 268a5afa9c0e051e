"""Each stage of the pipeline against brute force on its own input."""

import collections
import random

import public_tokenizers
import tiktoken

import corpus_pipeline as cp
from ledgerloom.llm import byte_bpe, quality_rules
from test_dedup import line_brute, near_brute


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]


def corpus():
    r = random.Random(8)
    line = lambda: " ".join(f"w{r.randrange(300)}" for _ in range(r.randint(8, 30)))
    shared = [line() for _ in range(4)]
    rows = []
    for i in range(60):
        lines = [line() for _ in range(r.randint(3, 8))]
        if i % 4 == 0:
            at = r.randrange(len(lines))
            lines[at:at] = shared[:3]
        rows.append((i, "\n".join(lines)))
    rows += [(100, rows[1][1]), (101, rows[2][1].replace("w1", "w2", 1)), (102, "short"), (103, ""), (104, None), (105, "junk ### " * 80), (106, "one two three " * 60)]
    return rows


def test_stages(spark, docs_of, tmp_path):
    rows = corpus()
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(105, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, sf, stages = docs_of(rows), str(tmp_path), dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "mixing", "byte_bpe"]

    kept = stages["quality_rules"](spark, docs, sf)
    verdict = {r.doc_id: r.quality.kept for r in quality_rules.quality_rules(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert tuple(kept.columns) == cp.COLUMNS
    before = rows_of(kept)
    assert [i for i, _ in before] == sorted(i for i, k in verdict.items() if k) and not {102, 103, 104, 106} & {i for i, _ in before}

    lines = stages["line_dedup"](spark, kept, sf)
    assert tuple(lines.columns) == cp.COLUMNS
    assert rows_of(lines) == sorted((i, t) for i, _, _, t in line_brute(before, 2))
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    after = rows_of(lines)
    single = stages["minhash_near_dedup"](spark, lines, sf)
    assert [i for i, _ in rows_of(single)] == sorted(i for i, _, _, k in near_brute(after, 5) if k)

    source = {r.doc_id: r.source for r in single.collect()}
    mixed = stages["mixing"](spark, single, sf)
    assert tuple(mixed.columns) == cp.COLUMNS
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    size = {i: len(t.split()) for i, t in rows_of(single)}
    assert max(copies.values()) <= 2 and abs(sum(size[i] * n for i, n in copies.items()) - 1.5 * sum(size.values())) <= 2 * max(size.values()) and set(copies) <= set(source)

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(cp.VOCABULARY), special_tokens={})
    tokens = stages["byte_bpe"](spark, mixed, sf).collect()
    text = dict(rows_of(mixed))
    assert len(tokens) == sum(copies.values()) and all(t.token_ids == library.encode_ordinary(text[t.doc_id]) and t.n_tokens == len(t.token_ids) for t in tokens)


def test_one_line_passages_go(spark, docs_of):
    passage = " ".join(f"q{i}" for i in range(50))
    short = passage.rsplit(" ", 1)[0]
    rows = [(1, f"own 1\n{passage}\nend 1"), (2, f"own 2\n{passage}\nend 2"), (3, f"own 3\n{short}\nend 3"), (4, f"own 4\n{short}\nend 4"), (5, passage)]
    assert rows_of(cp.dedup_lines(spark, docs_of(rows), "")) == [rows[0], (2, "own 2\nend 2"), rows[2], rows[3], (5, "")]


def test_one_row_of_a_group_stays(spark, docs_of):
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(None, text), (None, text + " x"), (7, text), (7, text), (3, other), (3, other + " y"), (9, None), (9, None), (None, ""), (5, "p q r"), (5, "p q r")]
    got = sorted(rows_of(cp.dedup_near(spark, docs_of(rows), "")), key=str)
    assert len(got) == 6 and [g for g in got if g[0] not in (3, None)] == sorted([(5, "p q r"), (7, text), (9, None), (9, None)], key=str)
    assert (None, "") in got and sum(g[0] == 3 for g in got) == 1
    nulls = rows_of(cp.dedup_near(spark, docs_of([(None, text)] * 3 + [(None, text + " x")]), ""))
    assert len(nulls) == 1


def test_run(spark, docs_of, tmp_path):
    docs_of(corpus()).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).count() > 40


def test_empty_tables(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
