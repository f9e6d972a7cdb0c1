import random
from collections import Counter

import corpus_pipeline as cp

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["ta", "re", "mi", "no", "lu", "se"]) for _ in range(rng.randrange(1, 5)))
    passage = " ".join(word() for _ in range(60))
    rows, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.2
        text = " ".join([word() for _ in range(rng.randrange(20, 90))] + ["idiot moron"] * toxic)
        rows.append([i, text, "en", rng.choice("abc")])
        labels.append((i, int(toxic)))
    clean = [r for r in rows if "idiot" not in r[1]]
    for k, (i, t, *_) in enumerate(clean[:20]):
        rows.append([2000 + k, t + " extra", "en", "a"])
    for k in range(5):
        rows.append([3000 + k, f"{' '.join(word() for _ in range(30))}\n{passage}  {' '.join(word() for _ in range(30))}", "en", "b"])
    rows += [[4000, None, None, None], [4001, "", "en", "a"], [4002, "idiot " * 3, "en", "a"], [4003, "w " * 9000, "fr", "c"], [4004, clean[30][1], "en", "a"], [4004, clean[30][1], "en", "a"]]
    return [(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows], labels, passage


def test_stages(spark, tmp_path):
    rows, labels, passage = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
    text = {i: t for i, t, *_ in rows}
    toxic = {i for i, t, *_ in rows if t and "idiot" in t}
    kept = {r.doc_id for r in seen["toxicity"]}
    assert not kept & toxic and len(kept) >= 0.98 * len(set(text) - toxic)
    near = Counter(r.doc_id for r in seen["near_copies"])
    assert all(n == 1 for n in near.values()) and 4000 in near and 4001 in near and 4004 not in near
    assert all(2000 + k not in near for k in range(20) if len(text[2000 + k].split()) > 40)
    cut = {r.doc_id: r for r in seen["passages"]}
    assert sum(passage in (r.text or "") for r in cut.values()) == 1
    whole = [r for i, r in cut.items() if i < 3000]
    assert all(r.text == text[r.doc_id] for r in whole) and all(r.n_chars == len(r.text) for r in cut.values() if r.text is not None)
    words = lambda rs: sum(len((r.text or "").split()) for r in rs)
    assert abs(words(seen["mix"]) - words(seen["passages"])) <= 0.02 * words(seen["passages"])
    assert sum(r.n_tokens for r in seen["packing"]) == words(seen["mix"])
    again = cp.run(spark, str(tmp_path)).collect()
    assert Counter(map(str, again)) == Counter(map(str, seen["packing"]))
