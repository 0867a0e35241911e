"""The registered queries and the pipeline over the smallest tables: against their SQL, or a brute-force version."""

import glob
import os
import re
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from test_documents import brute_components, shingles
from tessera.llm import mixture, quality_rules, registry, sentencepiece_codec
from tessera.llm.queries_documents import tokenizer_path


def values(rows):
    return Counter(tuple(rows_ if not isinstance(rows_, dict) else rows_.values()) for rows_ in rows)


def oracle(sql, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir)
    names, rows = oracle(registry.oracle_sql()[name], sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(rows)


def pieces_by_loops(df, texts):
    """(doc_id, text) of each stretch, from the slots of the mix and where documents stand in their sources; ids are unique."""
    mixed = mixture.Mixture(df)
    placed = defaultdict(list)
    for r in mixed.documents.collect():
        placed[r["rank"]].append((r["start"], r["start"] + r["size"], r["id"]))
    taken = defaultdict(list)
    for slot in mixed.slots.collect():
        low = slot["block"] * 512
        for begin, end, i in placed[slot["rank"]]:
            a, b = max(begin, low), min(end, low + slot["words"])
            if a < b:
                taken[i, slot["epoch"]].append((a - begin, b - begin, end - begin))
    for (i, _), found in taken.items():
        found.sort()
        runs = [list(found[0])]
        for a, b, size in found[1:]:
            if a == runs[-1][1]:
                runs[-1][1] = b
            else:
                runs.append([a, b, size])
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[i])]
        for a, b, size in runs:
            yield i, texts[i] if b - a == size else texts[i][words[a][0] : words[b - 1][1]]


def test_pipeline_equals_brute_force(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_rules.judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)  # its own tests compare it with SQL
    kept = {r["doc_id"] for r in judged.where("kept").collect()}
    last = defaultdict(int)
    for i in kept:
        last[docs[i]["text"]] = max(last[docs[i]["text"]], i)
    kept = set(last.values())
    roots = brute_components({i: shingles(docs[i]["text"]) for i in kept})
    kept = {i for i, root in roots.items() if root == i}
    want, words = Counter(), Counter()
    processor = sentencepiece_codec.load(tokenizer_path())
    mixed = spark.createDataFrame([docs[i] for i in sorted(kept)])
    for i, text in pieces_by_loops(mixed, {i: docs[i]["text"] for i in kept}):
        want[i, len(processor.encode(text))] += 1
        words[i] += len(re.findall(r"[^\x20\x09-\x0D]+", text))
    # what the mix says that it takes of each document is what its slots cover
    assert {r["doc_id"]: r["taken"] for r in mixture.mix(mixed).where("taken > 0").collect()} == words
    got = corpus_pipeline.run(spark, sf_dir)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got.select("doc_id", F.col("n_tokens")).collect()) == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "ngram_join", "mixture", "sentencepiece"]


def test_mixture_stage_meets_targets_to_the_word(spark):
    """Also where a source of over a quarter of all rows has a target of far less than its size and documents are far longer than blocks: kept words are the targets, and long documents keep their share."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(3000 if i % 9 == 0 else 40 + i % 300)), "en", "b" if i % 7 < 2 else f"c{i % 10}", 0) for i in range(400)] + [(400, "one word", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    targets = {r["source"]: (r["target"], r["source_size"]) for r in mixture.mix(docs).collect()}
    assert targets["b"][0] < 0.45 * targets["b"][1]
    found = corpus_pipeline.mixture(spark, docs, "").collect()
    kept, long_words = Counter(), 0
    for r in found:
        n = len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
        kept[r["source"]] += n
        long_words += n * (r["doc_id"] % 9 == 0 and r["source"] == "b")
    assert all(abs(kept[s] - t) <= 1 for s, (t, _) in targets.items())
    size = sum(3000 for i in range(0, 400, 9) if i % 7 < 2)
    assert abs(long_words / size - targets["b"][0] / targets["b"][1]) < 0.1


ODD = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, "x " * 30_000, "de", "a", 1), (None, "no id but words enough to pass the base rules of the first stage", "en", "b", 2)]
ODD += [(i, f"text number {i} has some words of its own and then a few that all of them share {i * i}", "en", None if i % 3 else "hot", i) for i in range(10, 40)]
ODD += [ODD[-1], (40, "text number 40 has some words of its own and then a few", "fr", "b", 3), (40, "quite another text of the same number with enough words to be kept here", "fr", "b", 3)]


@pytest.mark.parametrize("rows", [[], ODD])
def test_pipeline_of_odd_and_empty_tables(spark, tmp_path, rows):
    """Nulls, empty and long texts, repeated rows, a repeated id and columns named like the operators' own pass all stages, which keep the columns of documents."""
    from pyspark.sql import functions as F

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumns({n: F.lit("x") for n in ("id", "kept", "row", "digest", "size", "taken", "bucket", "n_words", "token", "__key", "component_id")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, *_ in rows[:5]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, now, str(tmp_path))
        assert found.columns == docs.columns
        found.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == now.count()
    if rows:
        kept = spark.read.parquet(f"{tmp_path}/ngram_join")
        assert kept.where("doc_id = 40").count() == 2 and kept.where("doc_id = 39").count() == 2
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
