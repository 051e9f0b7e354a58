import hashlib
import random

from llm_rows import write
from test_near_copies import brute_groups
from test_near_duplicates import contained, kept_lines
from test_text_scans import LANGS
from tokenizers import Tokenizer

import corpus_pipeline
from cellmend.llm import queries


def corpus():
    rand = random.Random(8)
    shared = "This line stands on the pages of many documents."
    item = " ".join(f"question{k} of" for k in range(12))
    rows = []
    for i in range(90):
        lang = rand.choice(sorted(LANGS))
        words = rand.choices(LANGS[lang].split(), k=40)
        text = " ".join(words) + (f"\n{shared}" if i % 7 == 0 else "") + (f"\n{item}" if i % 11 == 5 else "")
        rows.append((i, text, lang))
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(5)]
    rows += [(300, None, "en"), (301, "", "en"), (302, "12 34", "de")]
    return rows, [(0, item), (1, "not anywhere in these documents at all, really")]


def test_the_stages(spark, tmp_path):
    rows, items = corpus()
    documents = [(i, t, lang, "src", len(t or "")) for i, t, lang in rows]
    sf = write(spark, tmp_path, documents=(documents, "doc_id long, text string, lang string, source string, n_chars long"), benchmark=(items, "item_id long, text string"))
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    told = [(i, t) for i, t, _ in rows if i < 300]
    texts = {i: "\n".join(kept) for i, (_, kept) in kept_lines(told).items()}
    ids = sorted(texts)
    group = brute_groups([texts[i] for i in ids])
    texts = {i: texts[i] for k, i in enumerate(ids) if group[k] == k}
    leaks = {int(i) for i, *_ in contained(sorted(texts.items()), items)}
    texts = {i: t for i, t in texts.items() if i not in leaks}
    assert set(found) == set(texts) and leaks
    tokenizer = Tokenizer.from_file(queries.BYTE_BPE)
    for i, r in found.items():
        assert r["n_tokens"] == len(tokenizer.encode(texts[i]).ids) and r["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest()


def test_stages_keep_the_columns_and_stand_empty_tables(spark, tmp_path):
    rows, items = corpus()
    documents = [(i, t, lang, "src", len(t or "")) for i, t, lang in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    sf = write(spark, tmp_path, benchmark=(items, "item_id long, text string"))
    for data in (documents[:8], []):
        docs = spark.createDataFrame(data, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == corpus_pipeline.COLUMNS
            assert out.count() <= len(data)
