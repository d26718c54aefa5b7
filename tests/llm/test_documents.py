"""Operators on documents, against brute force and the tokenizer libraries."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import bpe, lines, minhash, mixing, quality, token_counts, token_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


VOCAB = ["the", "of", "and", "river", "stone", "über", "naïve", "Straße", "a", "b1", "42", "don't", "x…", "«quote»", "end.", "so,", "中文", "🙂", "café"]


def random_text(rng, n):
    seps = [" "] * 12 + ["\n", "  ", "\t", " \n", "\n\n", " ", "\x1c", " "]
    return "".join(rng.choice(VOCAB) + rng.choice(seps) for _ in range(n))


def odd_texts(seed=5):
    rng = random.Random(seed)
    fixed = [None, "", " ", "\n", "a", " lead", "trail ", "a\n", "\na", "a \nb", "don't DON'T we'll", "x" * 5000, "ab" * 3000 + " tail", "é É ẖ H̱", "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "\x01 a\x01b", "ΣΑΣ σας", "1234567890 ½ ² Ⅷ", "…. .,. ,,", "a​b ﻿", "\x1cab\x1d", "word. word, word; ünd. éa,"]
    return fixed + [random_text(rng, rng.randint(1, 60)) for _ in range(60)] + [random_text(rng, 4000)]


# --- op4


def tiktoken_encoding():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library():
    own, lib = bpe.encoder(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN), tiktoken_encoding()
    for text in odd_texts()[1:] + odd_texts(6)[-20:]:
        assert own.encode(text) == lib.encode_ordinary(text), text[:80]
        assert own.decode(own.encode(text)) == text.encode()


def test_rank_queue_pops_in_order():
    rng, queue = random.Random(1), bpe.RankQueue(300_000)
    pushed = [(rng.randrange(300_000) if rng.random() < 0.9 else 77, i) for i in range(3000)]
    for rank, at in pushed:
        queue.push(rank, at)
    out = []
    while (rank := queue.first()) >= 0:
        out += [(rank, at) for at in queue.take(rank)]
    assert out == sorted(pushed)
    assert not queue.top and not any(queue.low) and not any(queue.mid)


def test_bpe_joins_neighbours_once(monkeypatch):
    rng = random.Random(3)
    words = [w.encode() for w in {"".join(rng.choice(["an", "eß", "th", "aa", "\0", "ç", "🙂", "ung"]) for _ in range(rng.randint(2, 12))) for _ in range(2000)}]
    own, lib, looked = bpe.ByteBPE(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN), tiktoken_encoding(), []
    join = own.join
    monkeypatch.setattr(own, "join", lambda *a: looked.append(a) or join(*a))
    once = own.merge(words)
    assert once == [lib._encode_single_piece(w) for w in words]
    # Pairs of bytes come from a table; later ones are looked up when they are new, not each time that they come up.
    assert len(looked) < sum(map(len, words)) / 4
    looked.clear()
    assert own.merge(words[::-1]) == once[::-1] and not looked
    monkeypatch.setattr(bpe, "JOINS", 50)
    assert own.merge(words) == once


def test_bpe_frame(spark):
    texts = odd_texts()
    docs = frame(spark, texts).withColumn("N_TOKENS", F.lit("clash"))
    got = bpe.encoded(docs, ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))
    assert got.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    lib = tiktoken_encoding()
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode_ordinary(r["text"] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    back = bpe.decoded(got.select("doc_id", "text", "ids"))
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back.collect())
    assert bpe.encoded(docs.limit(0)).count() == 0


# --- op6


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(spark, tmp_path, name):
    texts = [*odd_texts(), "same text and more " * 20_000] + ["same text"] * 30
    docs, path, cache = frame(spark, texts).withColumns({"N_tokens": F.lit("clash"), "digest": F.lit("clash"), "content": F.lit(1)}), public_tokenizers.path(name), f"file://{tmp_path}/cache"
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    for _ in range(2):
        for r in token_counts.counted(docs, cache, path, limit=20).collect():
            t = r["text"] or ""
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), count(t), count(t) > 20), t[:50]
        stored = spark.read.parquet(cache)
        # The second run finds everything.
        assert stored.count() == len({t or "" for t in texts})
    token_counts.counted(frame(spark, ["one more", "same text"]), cache, path).collect()
    assert spark.read.parquet(cache).count() == len({t or "" for t in texts}) + 1
    assert token_counts.counted(docs.limit(0), None, path).count() == 0


# --- op8


def test_codes_are_addressable():
    import numpy as np

    rng = np.random.default_rng(3)
    for ids in (np.zeros(0, "u4"), np.array([0], "u4"), np.array([255, 256, 65535, 65536, 2**32 - 1], "u4"), rng.integers(0, 49408, 5000).astype("u4"), (rng.random(3000) ** 8 * 2**32).astype("u4")):
        codes = token_file.Codes(token_file.pack(ids))
        assert len(codes) == len(ids)
        assert (codes.slice(0, len(ids)) == ids).all()
        for i in {0, 1, len(ids) // 2, 511, 512, 513, len(ids) - 1}:
            if 0 <= i < len(ids):
                assert codes[i] == ids[i]
        for _ in range(20):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            assert (codes.slice(a, b) == ids[a:b]).all()


def test_words_equal_library_on_odd_letters():
    import numpy as np
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_file.VOCABULARY)
    rng, library, words = random.Random(31), Tokenizer.from_file(path), token_file.encoder(path)
    pieces = ["İ", "I", "ı", "i", "BİLGİ", "Aİ", "é", "e\u0301", "ẞ", "ß", "Σ", "ς", "ŉ", "Ǆ", "K", "Å", "½", "ª", "中", "🙂", "'s", "'", "-", ".", ",", "(", "!", "<|endoftext|>", "<|", " ", " ", "\n", "\u00a0", "\u0307", "\u200d", "a", "b", "the", "42", "\x01", "x"]
    texts = ["İ-", "BİLGİ.", "Aİ,", "İİ!"] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    for start in range(0, len(texts), 1000):
        some = texts[start : start + 1000]
        for text, ids, want in zip(some, words.encode(some), library.encode_batch(some, add_special_tokens=False), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == want.ids, repr(text)


def test_token_file(spark):
    import numpy as np
    from tokenizers import Tokenizer

    texts = odd_texts() + odd_texts(9)[-40:]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_file.VOCABULARY))
    path = token_file.write(frame(spark, texts).select("doc_id", "text", F.lit(1).alias("codes")), shard_tokens=500)
    got = {r["doc_id"]: r for r in token_file.read(spark, path).collect()}
    assert len(got) == len(texts)
    start, everything = 0, []
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), (t or "")[:60]
        start += len(ids)
        everything += ids
    at = [0, 1, 499, 500, 501, start // 2, start - 1]
    assert token_file.token_at(spark, path, at) == [everything[p] for p in at]
    assert token_file.read(spark, token_file.write(frame(spark, texts).select("doc_id", "text").limit(0))).count() == 0


# --- op5


def brute_quality(text):
    text = text or ""
    ws = WORD.findall(text)
    wins = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    many = Counter(wins)
    repeated = {i + k for i, w in enumerate(wins) if many[w] > 1 for k in range(5)}
    ls = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(ls) - len(set(ls)), len(repeated)


def test_quality(spark):
    rng = random.Random(2)
    texts = odd_texts() + ["a b c d e"] + ["a b c d e a b c d e", "x y " * 30, "one line\none line\n\n \nother"] + [" ".join(rng.choice("abc") for _ in range(rng.randint(5, 60))) for _ in range(40)]
    docs = frame(spark, texts).withColumn("kept", F.lit("clash")).withColumn("_metrics", F.lit(0))
    for r in quality.judged(docs).collect():
        want = brute_quality(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r["text"]
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality.judged(docs.limit(0)).count() == 0
    # Clean texts of other scripts have none of the stop words, and no spaces where words end.
    russian = "Сегодня утром мы пошли к реке и долго смотрели на воду, а потом вернулись домой пить чай."
    chinese = " ".join(["今天早上我们沿着河边散步看见许多人在那里钓鱼", "后来大家一起回家喝茶聊天直到很晚才去睡觉", *"一二三四五六七八九"])
    assert [r["kept"] for r in quality.judged(frame(spark, [russian, chinese, "xkcd qwrt " * 3 + " ".join(f"zz{i}" for i in range(20))])).orderBy("doc_id").collect()] == [True, True, False]


# --- op10


def test_mixing(spark):
    rng = random.Random(4)
    sources = ["big"] * 600 + ["b", None, "c", "tiny", "", "é"] * 50
    texts = [None if rng.random() < 0.02 else "w " * rng.randint(0, 80) for _ in sources]
    docs = frame(spark, texts, sources).withColumn("size", F.lit("clash")).withColumn("salt", F.lit("clash"))
    mixed = mixing.mix(docs)
    rows = mixed.collect()
    assert len(rows) == len(texts) and mixed.columns == [c for c in docs.columns if c != "size"] + ["size", "source_size", "target", "copies"]
    size = {s: sum(len(WORD.findall(t or "")) for t, x in zip(texts, sources, strict=True) if x == s) for s in set(sources)}
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, open_, target = sum(size.values()), set(size), {}
    while True:  # by rounds: cap what is above, reshare the rest
        rest = total - sum(3 * size[s] for s in size if s not in open_)
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * size[s]}
        if not above:
            target = {s: share.get(s, 3 * size[s]) for s in size}
            break
        open_ -= above
    for r in rows:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["copies"] <= 3
    for s in size:
        taken = sum(r["copies"] * r["size"] for r in rows if r["source"] == s)
        assert abs(taken - target[s]) <= max(0.05 * target[s], 3 * 80)
    again = {(r["doc_id"], r["copies"]) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in rows}
    assert mixing.emit(mixed, ["doc_id"]).count() == sum(r["copies"] for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [r["copies"] for r in mixing.mix(frame(spark, [None, " "])).collect()] == [0, 0]
    narrow = {(r["doc_id"], r["copies"]) for r in mixing.mixed_sizes(docs).collect()}
    assert narrow == again


def test_mixing_of_null_and_repeated_ids(spark):
    rows = [(None, f"text {i} " + "w " * (i % 7), "s") for i in range(40)] + [(5, f"copy {i % 3}", "t") for i in range(30)] + [(6, "w " * 50_000, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    run = lambda d: sorted((r["doc_id"] or 0, r["text"], r["copies"]) for r in mixing.mix(d).collect())
    first = run(docs)
    assert len(first) == len(rows) and first == run(docs.repartition(5))
    assert all(0 <= c <= 3 for _, _, c in first)
    assert sum(c for _, _, c in first) > 0


# --- op2 and op9


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if find(a) != find(b) and linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def variants(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    texts = [None, "", " \n", "one", "One", "one two three four", "ONE two three\tfour"]
    for _ in range(25):
        base = rng.sample(words, rng.randint(4, 150))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    base = rng.sample(words, 120)
    for k in range(20):  # a chain: only neighbours are linked
        texts.append(" ".join(base[k * 4 : k * 4 + 60]))
    hub = rng.sample(words, 100)
    texts.append(" ".join(hub))
    for _ in range(30):  # variants that are linked through the hub
        texts.append(" ".join([w if i not in (at := set(rng.sample(range(100), 2))) and rng.random() > 0 else rng.choice(words) for i, w in enumerate(hub)]))
    rng.shuffle(texts)
    return texts + ["the same again and again and again"] * 20


def shingle_set(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = WORD.findall(ws)
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def test_minhash(spark):
    texts = variants(8)
    sets = [shingle_set(t) for t in texts]
    want = components(len(texts), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())
    left = minhash.one_of_each(docs.withColumn("gone", F.lit(1)))
    assert left.columns == [*docs.columns, "gone"] and {r["doc_id"] for r in left.collect()} == set(want)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    nulls = minhash.near_duplicates(docs.withColumn("doc_id", F.lit(None).cast("long")).limit(5)).collect()
    assert len(nulls) == 5 and all(r["kept"] and r["component_id"] is None for r in nulls)


def test_minhash_of_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = a.replace("a39", "changed")
    rows = [(5, a), (5, b), (5, a), (8, near), (9, b + " more"), (2, c), (None, a), (None, "alone"), (4, b)]
    got = sorted(((r["doc_id"] or 0), r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"])
    # All texts of doc_id 5 are one document: it links those near a to those near b.
    assert got == [(2, 36, 2, True), (4, 36, 4, True), (5, 36, 4, False), (5, 36, 4, False), (5, 36, 4, False), (8, 36, 4, False), (9, 37, 4, False)]


def test_minhash_of_a_very_long_text(spark):
    rng = random.Random(23)
    words = [f"w{rng.randrange(5000)}" for _ in range(40_000)]
    changed = [w if i % 100 else "changed" for i, w in enumerate(words)]
    other = [w if i % 9 else "other" for i, w in enumerate(words)]
    texts = [" ".join(words), " ".join(changed), " ".join(other)]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    sets = [shingle_set(t) for t in texts]
    want = components(3, lambda x, y: 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]))
    assert [got[i]["component_id"] for i in range(3)] == want == [0, 0, 2]


def test_minhash_refuses_what_its_minima_miss():
    for call in (minhash.near_duplicates, minhash.one_of_each):
        with pytest.raises(ValueError, match="percent"):
            call(None, percent=50)


@pytest.mark.parametrize("most", [lines.BROADCAST, 0])
def test_fuzzy_lines(spark, monkeypatch, most):
    monkeypatch.setattr(lines, "BROADCAST", most)
    rng = random.Random(11)
    pool = [t for t in variants(3) if t and t.strip()]
    texts = [None, "", "\n \n", "Same line here.\n\nsame line here. \nother words"] + ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts += ["x" * 3000 + " a b c", "x" * 3000 + " a b c\nfresh line of words"]
    docs = frame(spark, texts).withColumn("gone", F.lit(7)).withColumn("N_removed", F.lit(1))
    at = [(d, i, x) for d, t in enumerate(texts) for i, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    sets = [positions(x) for _, _, x in at]
    comp = components(len(at), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    keep, seen = set(), set()
    for (d, i, _), c in zip(at, comp, strict=True):
        if c not in seen:
            seen.add(c)
            keep.add((d, i))
    lines_at = {(d, i) for d, i, _ in at}
    rows = lines.without_lines(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        if t is None:
            assert r["text"] is None
            continue
        d = r["doc_id"]
        assert r["text"] == "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in lines_at or (d, i) in keep), d
        assert r["n_lines"] == len(t.split("\n")) and r["n_removed"] == sum(1 for i in range(len(t.split("\n"))) if (d, i) in lines_at - keep)
    assert lines.without_lines(docs.limit(0)).count() == 0


def positions(line):
    """An independent definition: the 9 characters at every position, a shorter line whole."""
    line = line.strip(" \t\n\x0b\f\r").lower()
    return {line[i : i + 9] for i in range(max(1, len(line) - 8))}


def test_fuzzy_lines_of_null_and_repeated_ids(spark):
    line = "one line of some words that stands in several documents"
    rows = [(None, f"{line}\nnull id"), (7, f"{line}\nfirst text"), (7, f"other start\n{line}\n{line}"), (7, f"{line}\nfirst text"), (9, f"{line}\nlast"), (None, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["n_removed"]) for r in lines.without_lines(docs).collect())
    # Rows of one doc_id each keep their first such line; a null doc_id neither loses nor removes lines.
    assert got == sorted([(0, f"{line}\nnull id", 0), (7, f"{line}\nfirst text", 0), (7, f"other start\n{line}", 1), (7, f"{line}\nfirst text", 0), (9, "last", 1), (0, "", 0), (3, "", 0)])


def lines_left(spark, texts):
    return [r["text"] for r in lines.without_lines(frame(spark, texts)).orderBy("doc_id").collect()]


def kept_by_brute_force(texts):
    """Of documents of one line each, the first line of every component."""
    sets = [positions(t) for t in texts]
    comp = components(len(texts), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    return [t if i == c else "" for i, (t, c) in enumerate(zip(texts, comp, strict=True))]


def test_fuzzy_lines_of_changed_ends(spark):
    rng = random.Random(17)
    texts = []
    for _ in range(40):
        base = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(9, 14)))
        texts += [base, base[:-1] + "z", base + " [1]"]
    got = lines_left(spark, texts)
    assert got == kept_by_brute_force(texts)
    # One changed character at the end leaves all but one shingle: every variant goes.
    assert [t != "" for t in got] == [True, False, False] * 40


def test_fuzzy_lines_that_begin_alike(spark):
    urls = [f"https://www.example.org/{x}" for x in ("archive/2019/report", "people/contact", "terms")]
    words = ["internationalisation", "internationally", "internationalist movements", "andththwhes.", "andththwhwh."]
    unspaced = ["今天天气很好我们一起去公园散步吧", "今天天气很好我们一起在家里看电影", "🙂" * 9 + "αβγδεζηθ", "🙂" * 9 + "ικλμνξοπ", "🙂", "日", "日本"]
    apart = urls + words + unspaced
    near = ["長" + "今日本語文章空白無続行類似" * 2 + "丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥" + x for x in "甲乙"]
    got = lines_left(spark, apart + near)
    assert got == kept_by_brute_force(apart + near) == [*apart, near[0], ""]
