from __future__ import annotations

import hashlib
import os
import random
from collections import Counter

import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

from ledgermill.llm import bpe, itq, licenses, lines, mixing, sharding, simhash, substrings, topk, toxicity  # noqa: E402

from .test_dedup import brute_fingerprint, brute_lines, union_components  # noqa: E402

CLASHES = ["toxic", "_id", "_f", "score", "_gone", "_key", "_kept", "_m_id", "shard", "id", "h", "k1", "key", "row", "text_key", "n", "x", "name", "fp", "component"]


def _corpus():
    rng = random.Random(21)
    words = [f"{a}{b}" for a in ("tion", "er", "an", "th", "re", "on", "sel") for b in ("st", "ou", "ing", "ha", "en", "is", "ble", "mir")]
    menu = [f"the menu of the site number {k}" for k in range(6)]
    rows, labels = [], []
    for i in range(500):
        body = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 40))) for _ in range(rng.randint(1, 3))]
        if toxic := i % 8 == 0:
            body[0] += " grumblik you zorvash " + rng.choice(["plekto", "grumblik"])
        if rng.random() < 0.6:
            body.insert(0, rng.choice(menu))
        rows.append((i, "\n".join(body), "en", rng.choice([f"s{k}" for k in range(14)] + [None]), 0))
        labels.append((i, int(toxic), 1))
    copies = rng.sample([r for r in rows if r[0] % 8], 20)
    rows += [(1000 + k, r[1], "de", r[3], k) for k, r in enumerate(copies)]
    rows += [(None, copies[k][1] + " more", "fr", "s1", 0) for k in range(3)] + [(None, f"alone text number {k} here", None, None, 0) for k in range(3)]
    rows += [(7, "an unrelated text with that very id", "en", "s2", 0), (2000, None, None, None, None), (2001, "", "en", "s3", 0), (2002, menu[0], "en", "s4", 0), (2003, "er th " * 5000, "en", "s5", 0)]
    rows += [rows[3], rows[3], rows[9]]
    return rows, labels


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = _corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, labels


def bag(rows):
    return Counter(map(repr, map(tuple, rows)))


def test_each_stage_and_the_whole_like_brute_force(spark, corpus):
    folder, rows, labels = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]

    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scorer = toxicity.Scorer(model.entries)
    logit = lambda t: model.intercept + sum(w * f for w, f in zip(model.coefficients, scorer.features(t), strict=True))
    clean = [r for r in rows if logit(r[1]) < 0.8472978603872037]  # ln(0.7 / 0.3)
    toxic = {i for i, mark, _ in labels if mark}
    assert {r[0] for r in rows} - {r[0] for r in clean} == toxic
    got = stages["toxicity"](spark, docs, folder)
    assert got.columns == docs.columns
    assert bag(got.collect()) == bag(clean)

    # Rows that share an id share its boilerplate, so that ids may repeat.
    texts = brute_lines([(k, r[1], r[3]) for k, r in enumerate(clean)], lines.MIN_SITES, lines.MIN_CHARS)
    bare = [(r[0], texts[k], r[2], r[3], None if texts[k] is None else len(texts[k])) for k, r in enumerate(clean)]
    assert any(texts[k] != r[1] for k, r in enumerate(clean))
    frame = spark.createDataFrame(clean, docs.schema)
    assert bag(stages["line_dedup"](spark, frame, folder).collect()) == bag(bare)

    frame = spark.createDataFrame(bare, docs.schema)
    prints = {brute_fingerprint(r[1]) for r in bare}
    part = union_components(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2])
    groups = {}
    for r in bare:
        groups.setdefault(part[brute_fingerprint(r[1])], set()).add(r)
    kept = [tuple(r) for r in stages["near_dedup"](spark, frame, folder).collect()]
    assert len(kept) == len(groups) < len(bare)
    assert {part[brute_fingerprint(r[1])] for r in kept} == set(groups)
    for r in kept:
        group = groups[part[brute_fingerprint(r[1])]]
        assert r in group
        assert r[0] == min((g[0] for g in group if g[0] is not None), default=None)

    frame = spark.createDataFrame(kept, docs.schema)
    mixed = [tuple(r) for r in stages["mixing"](spark, frame, folder).collect()]
    plan = Counter()
    for r in mixing.mix_sources(frame).collect():
        plan[repr((r.doc_id, r.source, r.size))] += r.copies
    assert +plan == Counter(repr((r[0], r[3], len((r[1] or "").split()))) for r in mixed)
    assert set(mixed) <= set(kept)
    for source in {r[3] for r in kept}:
        own = [len((r[1] or "").split()) for r in kept if r[3] == source]
        target = next(r.target for r in mixing.mix_sources(frame).collect() if r.source == source)
        if sum(own):
            share = target / sum(own) % 1
            excess = sum(max(0, w - share * sum(own), w - (1 - share) * sum(own)) for w in own)
            order = sorted(own)
            alone = sum(w for k, w in enumerate(order) if w > sum(own) * mixing.GIANT and sum(order[:k]) < 3 * w)  # with little that is smaller
            assert abs(sum(len((r[1] or "").split()) for r in mixed if r[3] == source) - target) <= excess + alone + sum(own) * mixing.GIANT + 1e-6, (source, order, target)

    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    digests = []
    for r in mixed:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        digests.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert bag(stages["bpe"](spark, spark.createDataFrame(mixed, docs.schema), folder).collect()) == bag(digests)
    assert bag(pipeline.run(spark, folder).collect()) == bag(digests)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_names_of_other_columns_are_free(spark, corpus, tmp_path):
    folder, rows, labels = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is null or doc_id < 120 or doc_id >= 1000")
    extra = docs.selectExpr("*", *[f"{k} as `{name}`" for k, name in enumerate(CLASHES)])
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    path = bpe_path = public.path("word_bpe_49k.json")
    for stage in (lambda d: toxicity.score(d, toxicity.train(d, marks)), lambda d: bpe.encoding_digests(d, bpe_path), lambda d: substrings.substring_report(d, length=40, anchor=8), simhash.simhash_components, lines.line_report, licenses.scan):
        assert bag(stage(extra).collect()) == bag(stage(docs).collect())
    for stage in (sharding.stratified_shards, mixing.mix_sources):  # their draws are hashes of whole rows
        sizes = [Counter((r.doc_id, r.size) for r in stage(d).collect()) for d in (extra, docs)]
        assert sizes[0] == sizes[1]
    for _, stage in pipeline.STAGES[:-1]:
        got = stage(spark, extra, folder)
        assert got.columns == extra.columns
        assert got.count() > 0
        assert stage(spark, extra.limit(0), folder).count() == 0
    assert pipeline.STAGES[-1][1](spark, extra, folder).count() == extra.count()
    sharding.write_shards(extra, f"{tmp_path}/shards", n_shards=3, shard_col="part")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == extra.count()
    ids = bpe.decoded(bpe.encoded(docs.withColumn("row", docs.doc_id), path), path)
    assert ids.count() == docs.count()

    rng = random.Random(1)
    data = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    wide = vectors.selectExpr("*", *[f"{k} as `{name}`" for k, name in enumerate(CLASHES + ["v", "qb", "db", "code", "seg", "point", "c", "n_links"])])
    from pyspark.sql import functions as F

    assert bag(topk.top_k(wide, F.col("id") % 50 == 0).collect()) == bag(topk.top_k(vectors, F.col("id") % 50 == 0).collect())
    assert bag(itq.near_duplicates(wide).collect()) == bag(itq.near_duplicates(vectors).collect())
