"""Alignment against encoding each whole text and comparing all token ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from surveyframe.llm import alignment
from tests.conftest import SF_DIR

PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def whole(text, a, b):
    """Tokens of the whole text as (id, begin, end), or None."""
    raw = (" " + text).encode()
    got = [a.tokenizer.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text)]
    out = []
    for ids, table in zip(got, (a.bytes, b.bytes), strict=True):
        at, spans = 0, []
        for k in ids:
            spans.append((k, at, at + len(table[k])))
            at += len(table[k])
        if b"".join(table[k] for k in ids) != raw:
            return None
        out.append(spans)
    return out


def plain(rows):
    a, b = alignment.BytePieces(PATHS[0]), alignment.WordPieces(PATHS[1])
    spans = [whole(t, a, b) if t else None for _, t in rows]
    links, groups = [], []
    for s in spans:
        if s is None:
            links.append([])
            groups.append([])
            continue
        own, j = [], 0
        for x, lo, hi in s[0]:
            while s[1][j][2] <= lo:
                j += 1
            k = j
            while k < len(s[1]) and s[1][k][1] < hi:
                own.append((x, s[1][k][0]))
                k += 1
        links.append(own)
        cuts = sorted({e for _, _, e in s[0]} & {e for _, _, e in s[1]})
        parts, lo = [], 0
        for hi in cuts:
            parts.append("|".join(",".join(str(k) for k, p, q in side if lo <= p and q <= hi) for side in s))
            lo = hi
        groups.append(parts)
    count = Counter(p for own in links for p in own)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(n, top.get(y, 0))
    out = []
    for (i, _), s, own, parts in zip(rows, spans, links, groups, strict=True):
        sizes = (len(s[0]), len(s[1])) if s else (0, 0)
        best = sum(count[p] == top[p[1]] for p in own)
        out.append((i, *sizes, len(parts), len(own), best, sum(count[p] for p in own), hashlib.sha256(";".join(parts).encode()).hexdigest() if s else ""))
    return out, {(*p, n, n == top[p[1]]) for p, n in count.items()}


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, copies long, key string")
    got, pairs = alignment.align_tokens(df, *PATHS)
    want, told = plain(rows)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {tuple(r) for r in pairs.collect()} == told


@pytest.mark.parametrize("step", [alignment.SLAB, 40])
def test_odd_texts(spark, monkeypatch, step):
    rng = random.Random(step)
    alphabet = "abcdeABC  \n\t .,'!<>|0123éßñжш日本🎉▁\x00​"
    texts = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "don't stop", "<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b", "▁", "x " * 3_000, "日本語 のテスト", "é" * 500]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts += ["The quick brown fox's tokens  align over 1,234 words.\nNext lines, too."] * 30
    if step == 40:  # long texts are read in steps; one of them is odd only near its end
        monkeypatch.setattr(alignment, "_steps", lambda s, e: iter([(k, min(k + 3, len(s))) for k in range(0, len(s), 3)]))
        monkeypatch.setattr(alignment, "REMEMBERED", 5)
        texts += ["one two three four five six seven eight▁nine ten"]
    check(spark, [(k if k % 13 else None, t) for k, t in enumerate(texts)] + [(5, texts[9])])


def test_given_documents_and_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.collect()])
    assert alignment.align_tokens(docs.limit(0), *PATHS)[0].count() == 0


def test_packed_links():
    text, pair = np.array([2, 0, 0, 4, 2]), np.array([7, 3, 3, 9, 1])
    got = alignment.unpack_links(alignment.pack_links(text, pair, 6), 6)
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(zip(text.tolist(), pair.tolist(), strict=True))
    assert [len(x) for x in alignment.unpack_links(alignment.pack_links(text[:0], pair[:0], 2), 2)] == [0, 0]


def test_new_chunks_are_encoded_many_at_a_time(monkeypatch):
    import random

    import public_tokenizers

    from surveyframe.llm import alignment

    al = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(5)
    some = ["né", "ﬁne", "a▁b", "x​y", "it's", "１２", "<unk>", "</s>", "日本", "\x00", "..", "q" * 300]
    chunks = [(" " + "".join(rng.choice("abcxyzABC019.,é") for _ in range(rng.randint(1, 12)))).encode() for _ in range(3_000)]
    chunks += [f" {rng.choice(some)}{k if k % 3 else ' '}".encode() for k in range(400)]
    rng.shuffle(chunks)
    for tokenizer, size in ((al.a, al.size_a), (al.b, al.size_b)):
        alone = [tokenizer.encode([c.decode()])[0] for c in chunks]
        asked, encode = [], tokenizer.encode
        monkeypatch.setattr(tokenizer, "encode", lambda texts, encode=encode, asked=asked: asked.extend(texts) or encode(texts))
        flat, n = al._encoded(tokenizer, size, chunks)
        assert flat.tolist() == [k for ids in alone for k in ids] and n.tolist() == [len(ids) for ids in alone]
        regular = [c for c in chunks if c.isascii() and len(c) < 20 and not c.endswith(b" ")]
        asked.clear()
        al._encoded(tokenizer, size, regular)
        assert len(asked) < len(regular) / 20
    al._learn(chunks)
    of = lambda t, ids: b"".join(t.bytes[k] for k in ids)
    for c, odd, shown in zip(chunks, al.odd.tolist(), al.shown, strict=True):
        a, b = (t.encode([c.decode()])[0] for t in (al.a, al.b))
        assert odd == (of(al.a, a) != c or of(al.b, b) != c)
        groups = [tuple([int(k) for k in side.split(",")] for side in g.split("|")) for g in shown.decode().split(";")] if shown else []
        assert ([k for g in groups for k in g[0]], [k for g in groups for k in g[1]]) == (([], []) if odd else (a, b))
