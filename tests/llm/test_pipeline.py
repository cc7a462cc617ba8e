import corpus_pipeline
from monotrace.llm import decontaminate, line_windows, packing, quality, simhash
from monotrace.llm.queries import tokenizer_path
from pyspark.sql import functions as F

from .test_decontaminate import plain_matches
from .test_simhash import plain_fingerprint, plain_groups, plain_wide
from .test_tokens_and_packing import check_pieces

SF = "/root/testdata/sf0.001"


def plain_lines(rows):
    seen, out = {}, []
    for doc, text in rows:
        lines, gone = text.split("\n"), set()
        for k in range(len(lines) - 2):
            key = tuple(lines[k : k + 3])
            d, at = seen.setdefault(key, (doc, k))
            if (d, at) != (doc, k):
                gone |= set(range(max(k, at + 3) if d == doc else k, k + 3))
        out.append((doc, "\n".join(line for k, line in enumerate(lines) if k not in gone)))
    return out


def test_run_against_plain_stages(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = quality.fit(docs, labels)
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    kept = [(i, t) for i, t in rows if model.score(t) >= 0.3]
    assert len(kept) < len(rows)
    kept = plain_lines(kept)
    fps, wides = ({i: f(t, 5) for i, t in kept} for f in (plain_fingerprint, plain_wide))
    groups = plain_groups({i: fps[i] | wides[i] << 64 for i in fps}, simhash.NEAR_WIDE_BITS)
    assert len(set(groups.values())) < len(kept)
    kept = [(i, t) for i, t in kept if groups[i] == i]
    leaks = {d for d, _ in plain_matches(kept, items)}
    assert leaks
    kept = [(i, t) for i, t in kept if i not in leaks]
    check_pieces(corpus_pipeline.run(spark, SF).collect(), kept)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).cache()
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        none = stage(spark, docs.where(F.lit(False)), SF)
        assert none.columns == docs.columns and none.count() == 0


def test_stage_functions_take_odd_tables(spark, odd, empty):
    items, labels = spark.read.parquet(f"{SF}/benchmark.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    for table in (odd, empty):
        out = decontaminate.clean_documents(simhash.first_of_each(line_windows.without_repeated_lines(quality.accepted(table, labels))), items)
        assert out.columns == odd.columns
        packing.pack_documents(out, tokenizer_path("byte_bpe_50k.json")).collect()
