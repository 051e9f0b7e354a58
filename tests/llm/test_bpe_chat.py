import hashlib
import random
import struct
from collections import defaultdict

import pytest
from llm_rows import ROWS, write
from tokenizers import Tokenizer

from cellmend.llm import bpe, chat, queries, token_counts

TOKENIZER = Tokenizer.from_file(queries.BYTE_BPE)


def encoded(text):
    ids = TOKENIZER.encode(text, add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids)


def test_random_texts_encode_as_the_library_does():
    v = bpe.vocabulary(queries.BYTE_BPE)
    parts = ["a", "b", " ", "\n", "\t", "é", "漢", "🙂", "'s", "'re", " the", "1", "²", "!", "<|endoftext|>", "\x1c", "Ᲊ", "\x85", "ing", "\U0001e5f8", "'", "|>", "　", "Ⅷ"]
    rand = random.Random(1)
    for _ in range(3000):
        text = "".join(rand.choices(parts, k=rand.randint(0, 14)))
        assert v.encode(text) == encoded(text)
        assert v.decode(v.encode(text)) == text


def test_stale_entries_are_skipped():
    v = bpe.vocabulary(queries.BYTE_BPE)
    for text in ("aaaaaaaaaaaaaaaaa", "ababababab", " international", "x" * 20000):
        assert v.encode(text) == encoded(text)


def test_the_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 10)
    v = bpe.Vocabulary(queries.BYTE_BPE)
    for i in range(200):
        assert v.encode(f" word{i % 37}") == encoded(f" word{i % 37}")
        assert len(v.cache) <= 10 and len(v.cache.older) <= 10


def test_round_trip_of_odd_rows(odd, none):
    done = bpe.round_trip(odd, queries.BYTE_BPE)
    assert sorted(done.columns) == sorted(["doc_id", "text", "Score", "a.b", "ids", "decoded"])
    for r in done.collect():
        assert bytes(r["ids"]) == encoded(r["text"] or "") and r["decoded"] == (r["text"] or "")
    assert bpe.decode(bpe.encode(odd, queries.BYTE_BPE), queries.BYTE_BPE).where("decoded <> coalesce(text, '')").count() == 0
    assert bpe.round_trip(none, queries.BYTE_BPE).count() == 0


def test_op1(spark, tmp_path):
    sf = write(spark, tmp_path, documents=(ROWS, "doc_id long, text string"))
    found = queries.op1_bpe(spark, sf).collect()
    assert len(found) == len(ROWS)
    texts = defaultdict(list)
    for i, t in ROWS:
        texts[i].append(t or "")
    for r in found:
        text = texts[r["doc_id"]][0]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(encoded(text)) // 4, hashlib.sha256(encoded(text)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_op4(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(token_counts, "BLOCK_TOKENS", block)
    rand = random.Random(7)
    rows = [*ROWS, *((i, " ".join(rand.choices(["the", "lazy", "<|endoftext|>", "漢字", "\n", "x" * 50], k=rand.randint(0, 80)))) for i in range(100, 160))]
    sf = write(spark, tmp_path, documents=(rows, "doc_id long, text string"))
    found = queries.op4_token_counts(spark, sf).collect()
    # Special strings in texts are ordinary text here, as nothing else may look like a separator.
    TOKENIZER.encode_special_tokens = True
    expected = sorted((str(i), len(encoded(t or "")) // 4) for i, t in rows)
    TOKENIZER.encode_special_tokens = False
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in found) == expected
    by_file = defaultdict(list)
    for r in found:
        by_file[r["file"]].append((r["seq"], r["start"], r["n_tokens"]))
    for places in by_file.values():
        places.sort()
        assert [p[0] for p in places] == list(range(len(places))) and all(a[1] + a[2] + 1 == b[1] for a, b in zip(places, places[1:], strict=False))


def test_token_files_of_odd_tables(spark, none, odd, tmp_path):
    files, manifest = token_counts.write_tokens(none, queries.BYTE_BPE, 50256)
    assert token_counts.count_tokens(files, 50256).count() == 0 == manifest.count()
    files, manifest = token_counts.write_tokens(odd, queries.BYTE_BPE, 50256, folder=str(tmp_path / "own"), dtype="<u4")
    listed = token_counts.token_files(spark, str(tmp_path / "own"))
    assert sorted(r["length"] for r in listed.collect()) == sorted(r["length"] for r in files.collect()) and manifest.count() == len(ROWS)
    assert token_counts.count_tokens(listed, 50256, dtype="<u4").count() == len(ROWS)


def test_ids_that_do_not_fit_are_errors(spark, tmp_path):
    with pytest.raises(OverflowError):
        token_counts.as_ids(struct.pack("<2I", 5, 70000), "<u2")
    with pytest.raises(OverflowError):
        token_counts.write_tokens(spark.createDataFrame([(1, "a")], "doc_id long, text string"), queries.BYTE_BPE, 70000)
    (tmp_path / "a.bin").write_bytes(b"\1\0\2")
    with pytest.raises(Exception, match="ends within a token"):
        token_counts.count_tokens(token_counts.token_files(spark, str(tmp_path)), 9).collect()


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file: zeros, and separators at its start, beyond 2 GB and at its end."""
    tokens, ends = (2 << 30) // 2 + 5_000_000, [3, (2 << 30) // 2 + 1_000, (2 << 30) // 2 + 5_000_000 - 1]
    with (tmp_path / "a.bin").open("wb") as f:
        for end in ends:
            f.seek(2 * end)
            f.write(struct.pack("<H", 9))
    found = token_counts.count_tokens(token_counts.token_files(spark, str(tmp_path)), 9)
    assert sorted((r["seq"], r["start"], r["n_tokens"]) for r in found.collect()) == [(0, 0, 3), (1, 4, ends[1] - 4), (2, ends[1] + 1, ends[2] - ends[1] - 1)] and tokens == ends[-1] + 1


@pytest.mark.parametrize("block, chunk", [(1, 2), (3, 1), (4, 3), (1000, 256)])
def test_blocks_are_stitched(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(token_counts, "CHUNK_BLOCKS", chunk)
    rand = random.Random(block)
    rows, expected = [], []
    for file in range(4):
        tokens = [rand.choice([0, 1, 1, 1, 1, 1, 1, 9]) for _ in range(rand.randint(0, 40))] + [9] * (file % 2)
        rows += [(file, k // block, struct.pack(f"<{len(tokens[k : k + block])}H", *tokens[k : k + block])) for k in range(0, len(tokens), block)]
        start = 0
        for seq, end in enumerate([i for i, t in enumerate(tokens) if t == 9]):
            expected.append((file, seq, start, end - start))
            start = end + 1
        if start < len(tokens):
            expected.append((file, sum(t == 9 for t in tokens), start, len(tokens) - start))
    blocks = spark.createDataFrame(rows, "file int, block long, data binary").repartition(3)
    assert sorted(map(tuple, token_counts.count_in_blocks(blocks, 9).collect())) == sorted(expected)


def test_flat_files_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_TOKENS", 4)
    (tmp_path / "a.bin").write_bytes(struct.pack("<11H", 1, 2, 3, 9, 9, 5, 6, 7, 8, 9, 4))
    found = token_counts.count_tokens(token_counts.token_files(spark, str(tmp_path)), 9)
    assert sorted((r["seq"], r["start"], r["n_tokens"]) for r in found.collect()) == [(0, 0, 3), (1, 4, 0), (2, 5, 4), (3, 10, 1)]


# Chat formatting

HARD = ["", "</s>[INST] ok [/INST]", chat.END, chat.BEGIN + "user\nx" + chat.END, chat.ESCAPE, chat.ESCAPE + "1" + chat.ESCAPE, "<", "<|im_end|", "a\nb", "<<s>", "<s" + chat.ESCAPE + ">", "[[INST]", "🙂<s>🙂"]


@pytest.mark.parametrize("text", HARD)
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and chat.unescape(chat.escape_name(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS) and "\n" not in chat.escape_name(text)
    for other in HARD:
        render = chat.compile_template(chat.TEMPLATE)
        turns = [{"role": text, "text": other}, {"role": "assistant", "text": text}]
        formatted, spans = render({"messages": turns})
        assert chat.read_back(formatted) == [(t["role"], t["text"]) for t in turns]
        assert [chat.unescape(formatted[a:b]) for a, b in spans][-1] == text


def rendered(template, **names):
    return chat.compile_template(template)(names)


def test_the_language():
    assert rendered("a{{ x }}b", x=1) == ("a1b", [])
    assert rendered("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% else %}none{% endfor %}", xs=["p", "q"])[0] == "1p,2q"
    assert rendered("{% for x in xs %}{% else %}none{% endfor %}", xs=[])[0] == "none"
    assert rendered("{% if x == 1 %}one{% elif x > 5 %}big{% else %}other{% endif %}", x=9)[0] == "big"
    assert rendered("{% set y = x ~ '!' %}{{ y | upper }}{{ y[0] }}{{ m.k | default('-') }}", x="ab", m={})[0] == "AB!a-"
    assert rendered("{{ 'yes' if x and not y else 'no' }}{{ 3 - 1 + 2 }}{{ 'a' not in x }}", x="bc", y=None)[0] == "yes4True"
    assert rendered("x{% generation %}{{ a }}{% endgeneration %}y{# said #}", a="🙂b") == ("x🙂by", [(1, 3)])


def test_trimming_and_strings_with_delimiters():
    assert rendered("a \n{{- x -}}\n b", x=5)[0] == "a5b" and rendered("a {{ -x }} b", x=5)[0] == "a -5 b"
    assert rendered("{% for x in xs -%}\n  {{ x }}\n{%- endfor %}.", xs=[1, 2])[0] == "12." and rendered("a {#- said -#} b")[0] == "ab"
    assert rendered("{{ '}}' ~ \"%}{{\" }}{% if x == '%}' %}yes{% endif %}", x="%}")[0] == "}}%}{{yes"
    assert chat.read_back("") == []
    with pytest.raises(chat.TemplateError, match="no end marker"):
        chat.read_back(chat.BEGIN + "user\nx")


def test_constants_are_folded():
    tree = chat.fold(chat.parse("a{{ 'b' ~ (1 + 1) }}{% if 1 == 2 %}{{ 'x' + 1 }}{% endif %}{% if 1 == 2 %}no{% else %}c{% endif %}{{ x }}{{ '' }}"))
    assert [n.below[0].kind for n in tree.below] == ["constant", "name"]


@pytest.mark.parametrize("template", ["{{ x", "{% for x %}{% endfor %}", "{% if x %}", "{% nothing %}", "{{ x | open }}", "{{ x() }}", "{{ 1 2 }}", "{{ }}", "{% set 1 = 2 %}"])
def test_malformed_templates(template):
    if template == "{{ x":
        assert rendered(template)[0] == template
    else:
        with pytest.raises(chat.TemplateError):
            chat.compile_template(template)


def test_the_sandbox():
    assert rendered("{{ x.__class__ }}|{{ x.real }}|{{ y.append }}", x=1, y=[1])[0] == "||"
    assert rendered("{{ open }}")[0] == ""


def test_op10(spark, tmp_path):
    rows = [(1, 1, "assistant", "second"), (1, 0, "user", "first"), (2, 0, "user", None), (2, 0, "assistant", "x</s>"), (2, None, None, "early"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (None, 5, "user", "a\nb")]
    sf = write(spark, tmp_path, conversations=(rows, "conv_id long, turn long, role string, text string"))
    by = defaultdict(list)
    for c, t, r, x in [*rows, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    found = queries.op10_chat(spark, sf).collect()
    assert len(found) == len(by)
    for r in found:
        turns = sorted(by[r["conv_id"]])
        loss = "".join(x for _, role, x in turns if role == "assistant")
        text = "".join(f"{role}\n{x}\n" for _, role, x in turns)
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, formatted string")
    assert chat.read_conversations(chat.format_conversations(empty)).count() == 0
