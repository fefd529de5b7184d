import gc
import random
import time
import zlib

import corpus_pipeline
import numpy as np
import pytest
from lakelens.llm import common, decontaminate, language_id, mixing, ngram_jaccard
from lakelens.llm.common import read

from test_models import SOUNDS
from test_native import brute_copies, brute_hits
from test_ngram_jaccard import brute as brute_components
from test_token_store import plain

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = read(spark, SF, "documents")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "source_mixing", "token_store"]
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    known = corpus_pipeline.identify_language(spark, docs, SF).cache()
    model = language_id.fit(docs)
    want = {r["doc_id"] for r in docs.collect() if (p := model.predict([r["text"]]))[0][0] != "und" and p[1][0] >= 0.5}
    assert known.columns == names and ids(known) == want
    unique = corpus_pipeline.drop_near_duplicates(spark, known, SF).cache()
    found = ngram_jaccard.jaccard_components(known, size=5, num=80, den=100).collect()
    assert unique.columns == names and ids(unique) == {r["component_id"] for r in found}
    clean = corpus_pipeline.drop_contaminated(spark, unique, SF).cache()
    bad = ids(decontaminate.contaminated(unique, read(spark, SF, "benchmark")))
    assert bad and clean.columns == names and ids(clean) == ids(unique) - bad
    mixed = corpus_pipeline.mix_sources(spark, clean, SF)
    assert mixed.columns == names and mixed.count() == mixing.mix(clean).count()
    assert corpus_pipeline.run(spark, SF).count() == mixed.count()


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    """Documents of three languages, with near copies, benchmark passages, rows without a letter and rows without a text."""
    rng = random.Random(21)
    lang_of = lambda: rng.choice(list(SOUNDS))
    words = lambda lang, n: [f"{''.join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(2, 5)))}" for _ in range(n)]
    items = [(i, " ".join(words("aa", rng.randint(15, 30)))) for i in range(4)]
    rows = []
    for i in range(160):
        lang = lang_of()
        w = words(lang, rng.randint(20, 90))
        if i and i % 9 == 0:  # a copy of an earlier one, with a word changed
            w, lang = (rows[i // 2][1] or "").split() or w, rows[i // 2][2]
            w[0] = "changed"
        if i % 11 == 3:
            w, lang = [*words("aa", 20), *items[i % 4][1].split(), *words("aa", 20)], "aa"
        rows.append((i, " ".join(w), lang, rng.choice(["big", "big", "small", None]), 1))
    return items, rows + [(500, None, "aa", "big", 0), (501, "12 !!", "bb", "small", 1), (502, "", None, None, 0)]


@pytest.fixture
def folder(spark, tmp_path):
    items, rows = corpus()
    write = lambda data, schema, name: spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    write(rows, DOCS, "documents")
    write(items, "item_id bigint, text string", "benchmark")
    return str(tmp_path), items, rows


def test_against_a_plain_chain(spark, folder):
    """All five stages once more in plain Python. The model's own plain version is in test_models."""
    path, items, rows = folder
    model = language_id.fit(spark.createDataFrame(rows, DOCS))
    rows = [r for r in rows if (p := model.predict([r[1]]))[0][0] != "und" and p[1][0] >= 0.5]
    kept = {c for _, _, c in brute_components([(r[0], r[1]) for r in rows], 5, 80, 100)}
    unique = [r for r in rows if r[0] in kept]
    bad = {d for d, _ in brute_hits([(r[0], r[1], "") for r in unique], items)}
    clean = [r for r in unique if r[0] not in bad]
    assert len(rows) > len(unique) > len(clean) > 80
    size = {}
    for _, t, _, s, _ in clean:
        size[s] = size.get(s, 0) + len(t)
    weight = {s: n**0.5 for s, n in size.items()}
    rate = {s: weight[s] / sum(weight.values()) * sum(size.values()) / size[s] for s in size}
    want, start, ids = [], 0, plain()
    for d, t, _, s, _ in sorted(clean, key=lambda r: r[0]):
        coded = [*ids(t), 2]
        for _ in range(brute_copies(d, rate[s])):
            want.append((d, start, len(coded), zlib.crc32(np.array(coded, "<u4").tobytes())))
            start += len(coded)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, path).collect())
    assert got == sorted(want)


def test_stages_on_awkward_rows(spark, folder):
    """Null and empty values in every column, repeated rows and ids, a very long text, columns of clashing names, nothing."""
    path, items, _ = folder
    names = DOCS + ", __id bigint, __keep string, __s string, __n int, mix_copy int, cls string, h bigint, place int"
    more = (1, "k", "s", 2, 3, "c", 4, 5)
    long = " ".join(f"ka{i}ti mo{i}ra" for i in range(60_000))
    base = [(1, "kati mora kati tika moti rara kamo", "aa", "a", 1), (1, "kati mora kati tika moti rara kamo", "aa", "a", 1), (1, "schung verich ung verver schich ungung ich", "bb", None, None), (None, "moka tira " * 9, None, "a", 2), (2, None, None, None, None), (3, "", "", "", 0), (4, long, "aa", "b", 9), (5, items[0][1], "aa", "b", 9)]
    awkward = spark.createDataFrame([(*r, *more) for r in base], names)
    nothing = spark.createDataFrame([], names)
    learnt = spark.createDataFrame([(*r, *more) for r in corpus()[1]], names)
    for stage, (_, f) in zip("12345", corpus_pipeline.STAGES, strict=True):
        out, none = f(spark, awkward.unionByName(learnt), path), f(spark, nothing, path)
        assert none.collect() == []
        if stage != "5":
            assert out.columns == awkward.columns and none.columns == awkward.columns
    kept = [r for r in corpus_pipeline.drop_near_duplicates(spark, awkward, path).select("doc_id", "text").collect()]
    # Rows of one id with unlike texts both stay; of equal ones, one does.
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:6]) for r in kept) == [(0, "moka t"), (1, "kati m"), (1, "schung"), (2, ""), (3, ""), (4, "ka0ti "), (5, items[0][1][:6])]
    clean = corpus_pipeline.drop_contaminated(spark, awkward, path)
    assert sorted(r["doc_id"] or 0 for r in clean.collect()) == [0, 1, 1, 1, 2, 3, 4]
    mixed = corpus_pipeline.mix_sources(spark, awkward, path).collect()
    assert all((r["__id"], r["mix_copy"], r["__s"]) == (1, 3, "s") for r in mixed)
    stored = corpus_pipeline.store_tokens(spark, awkward, path).collect()
    assert len(stored) == len(base)


def test_the_driver_collects_between_tables(spark):
    common._collected[0] = -common.COLLECT_S
    assert common.materialize(spark.range(3), "collected").count() == 3 and common._collected[0] > 0


def test_the_driver_hands_memory_back(spark):
    """What a collection frees goes back to the system, rather than staying with the heap."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    kind = jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")
    most = lambda: jvm.java.lang.management.ManagementFactory.getPlatformMXBean(kind).getVMOption("MaxHeapFreeRatio").getValue()
    before, heap = most(), jvm.java.lang.Runtime.getRuntime()
    held = [array(jvm.long, 13 << 20) for _ in range(10)]
    assert heap.totalMemory() > 1000 << 20
    del held
    gc.collect()
    time.sleep(1)  # until the JVM is told
    common._collected[0] = -common.COLLECT_S
    common.materialize(spark.range(3), "handed-back")
    assert heap.freeMemory() < 0.5 * heap.totalMemory() and most() == before
    assert common._trim_jvm(spark)
