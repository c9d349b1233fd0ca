"""The operators against brute force, exact round trips and held-out rows; edge cases of each."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from momentloom.llm import bpe, classifier, ctw, jaccard, media, packing, quality, queries, substring_dedup, toxicity
from momentloom.llm.line_dedup import dedup_lines
from tests.oracle import duck_rows, rows_of

SF = "/root/testdata/sf0.001"
#: Nulls, empty and blank texts, a long one, repeated rows, a null id, odd characters.
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "word " * 4000), (5, "a b c"), (5, "a b c"), (None, "lonely text here."), (6, "x  y\x1c　z 漢字 😀 <|endoftext|> it's"), (7, "\n\nA\n a \nB\n"), (8, "ﬁ ß É i̇ .!? ?! ")]


@pytest.fixture(scope="module")
def edges(spark):
    """Edge rows with extra columns whose names operators use themselves."""
    rows = [(i, t, "en", "s", 0, "x", 1) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, kept int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(n=None):
    import duckdb

    return [(i, t or "") for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()][:n]


def test_bpe_equals_tiktoken_and_decodes(spark, edges):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ours = bpe.ByteBPE(path)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})
    rng = random.Random(1)
    sample = [t for _, t in texts(60)] + [t or "" for _, t in EDGES] + ["".join(rng.choice("ab's  \n\t.,!12é漢😀'll　\x1c") for _ in range(40)) for _ in range(500)]
    for t, packed in zip(sample, ours.encode(sample), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == theirs.encode_ordinary(t)
        assert ours.decode(packed) == t.encode()
    got = bpe.bpe_decode(bpe.bpe_encode(edges)).collect()
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t in EDGES)


def test_pieces_and_packing(spark, edges, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    whole = packing.DocumentTokens(path, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    sample = [t for _, t in texts()] + [t or "" for _, t in EDGES]
    want = [tok.encode(t, add_special_tokens=False).ids for t in sample]
    assert [np.frombuffer(x, "<u4").tolist() for x in whole.encode(sample)] == want
    for df in (docs.unionByName(edges.select(docs.columns)), docs.filter("false")):
        rows = packing.pack(packing.token_pieces(df)).collect()
        by_sequence, by_doc = {}, {}
        for r in rows:
            by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
            by_doc.setdefault(r.doc_id, []).append(r)
        for places in by_sequence.values():
            at = 0
            for o, n in sorted(places):
                assert o == at
                at += n
            assert at <= 1024
        total = sum(r.length for r in rows)
        assert len(by_sequence) <= -(-total // 1024) * 1.03 + 2
    rows = packing.pack(packing.token_pieces(docs)).collect()
    ids = {i: tok.encode(t, add_special_tokens=False).ids + [2] for i, t in texts()}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(struct.pack(f"<{len(own)}I", *own)) == r.ids_crc32
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))


def test_lines(spark, edges):
    assert rows_of(queries.op3_line_dedup(spark, SF)) == duck_rows(queries.SQL["op3_line_dedup"], SF)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in dedup_lines(edges, min_docs=2).collect()}
    assert got[1] == (1, 0, "") and got[7] == (6, 0, "\n\nA\n a \nB\n") and got[5] == (1, 1, "")
    assert dedup_lines(edges, min_docs=2).count() == len(EDGES) and dedup_lines(edges.filter("false")).count() == 0


def brute_components(rows, width, threshold):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = set(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else {tuple(w)} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= threshold * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((root(a), root(b)))
                    label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("width, threshold, block", [(4, 85, 2000), (5, 80, 7)])
def test_similar_documents_against_all_pairs(spark, width, threshold, block):
    rng = random.Random(width)
    rows, base = [], [rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(90)]
    for i in range(120):
        words = list(base) if i % 3 else [rng.choice("qrstuvwxyz") * rng.randint(1, 5) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.choice([0, 1, 2, 4, 6])):
            if words:
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 99)}"
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "one two"), (203, "One  TWO"), (204, "w " * 3000)]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, width=width, threshold=threshold, block=block).collect()}
    assert got == brute_components(rows, width, threshold)


def test_similar_documents_edges(spark, edges):
    got = jaccard.jaccard_components(edges).collect()
    assert len(got) == len(EDGES) and all((r.component_id is None) == (r.doc_id is None) for r in got)
    assert jaccard.jaccard_components(edges.filter("false")).count() == 0


def test_media_round_trip(spark, edges):
    rng = np.random.default_rng(0)
    payloads = [media.payload_of(x) for x in (b"", b"a", b"\xff" * 576, rng.integers(0, 256, 577, np.uint8).tobytes(), rng.integers(0, 256, 300_000, np.uint8).tobytes(), rng.integers(0, 256, 5_000_000, np.uint8).tobytes())]
    for p, pictures in zip(payloads, media.read_thumbnails([media.write_jpeg(p) for p in payloads]), strict=True):
        assert b"".join(x.tobytes() for x in pictures) == p
    rows = media.read_media(media.store_media(edges)).collect()
    assert sorted(bytes(r.thumbnail) for r in rows) == sorted(media.payload_of((t or "").encode()) for _, t in EDGES)
    with pytest.raises(ValueError):
        media.read_thumbnails([b"no picture"])


def test_reader_takes_ac_values_and_scans_without_restarts():
    """A picture of two blocks with AC values, written by hand: Huffman codes of four bits for all symbols used."""
    symbols_dc, symbols_ac = bytes(range(8)), bytes([0x00, 0x01, 0x11, 0xF0])
    head = b"\xff\xd8" + media._segment(0xDB, bytes([0] + [8] * 64)) + media._segment(0xC0, struct.pack(">BHHB", 8, 8, 16, 1) + bytes([1, 0x11, 0]))
    head += media._segment(0xC4, b"\x00" + bytes([0, 0, 0, 8] + [0] * 12) + symbols_dc) + media._segment(0xC4, b"\x10" + bytes([0, 0, 0, 4] + [0] * 12) + symbols_ac) + media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    bits = "0011" + "101" + "0001" + "1" + "0010" + "0" + "0000"  # DC +5, AC 1, a zero and AC -1, end
    bits += "0010" + "00" + "0011" + "0001" + "1" + "0000"  # DC -3, sixteen zeros, AC 1, end
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    (picture,) = media.read_thumbnails([head + data + b"\xff\xd9"])[0]
    assert picture.tolist() == [[133, 130]]


def test_quality_counts(spark, edges):
    rng = random.Random(5)
    for _ in range(300):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 25))]
        grams = Counter(zip(words, words[1:], words[2:]))
        want = {p for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for p in range(k, k + 3)}
        assert quality.repeated_window_words(words) == len(want)
    assert quality.counts("a b\n\na b\n #x\x0b|")[1:] == (7, 2, 1, 0)
    got = quality.quality_rules(edges).collect()
    assert len(got) == len(EDGES) and quality.quality_rules(edges.filter("false")).count() == 0
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 50)


def plain_measures(words, path):
    """Tokens, characters a token, single-byte share and entropy, counted token by token."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        found = [(i, pieces.is_byte(i)) for w in words for i in pieces.encode(w)]
    else:
        ranks = bpe.read_ranks(path)
        by_rank = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        found = [(i, len(by_rank.decode_single_token_bytes(i)) == 1) for w in words for i in by_rank.encode_ordinary(" " + w)]
    n, count = len(found), Counter(i for i, _ in found)
    return n, sum(map(len, words)) / n, sum(b for _, b in found) / n, -sum(c / n * math.log2(c / n) for c in count.values())


def test_quality_verdicts_against_plain_counting(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    bands = quality.fit_bands(docs, labels, hold_out=(2, 0))
    assert "en" in bands and "latin" in bands
    rows = quality.quality_rules(docs, bands=bands, keep=("text", "lang")).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and not r.base_failed]
    bad, good = [r.kept for r in held if not r.quality], [r.kept for r in held if r.quality]
    assert len(bad) >= 8 and sum(bad) <= 0.2 * len(bad) and sum(good) >= 0.95 * len(good)
    for r in held[:25]:
        words = [w for w in r.text.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
        ok = True
        for (name, file), band in zip(quality.VOCABULARIES, bands[r.lang if r.lang in bands else "latin"], strict=True):
            n, chars, share, entropy = plain_measures(words, public_tokenizers.path(file))
            assert (r[f"{name}_tokens"], r[f"{name}_chars_per_token"]) == (n, chars) and abs(r[f"{name}_entropy"] - entropy) < 1e-9 and abs(r[f"{name}_byte_share"] - share) < 1e-12
            x = min(max(math.log2(n), band.lengths[0]), band.lengths[1])
            rise = entropy - sum(c * x**k for k, c in enumerate(band.rise))
            ok = ok and band.chars[0] <= chars <= band.chars[1] and share <= band.most_bytes and band.entropy[0] <= rise <= band.entropy[1]
        assert r.kept == ok
    assert quality.fit_bands(docs, labels.filter("false")) == {} and quality.fit_bands(docs.filter("false"), labels) == {}


def test_bands_come_from_all_good_documents(spark):
    import inspect

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    assert "most_rows" not in inspect.signature(quality.fit_bands).parameters
    measured = quality.quality_rules(docs, keep=("lang",)).cache()
    bands = quality.bands_of(measured, labels, hold_out=(2, 0))
    good = {r.doc_id for r in labels.filter("quality = 1").collect() if zlib.crc32(str(r.doc_id).encode()) % 2}
    own = [r for r in measured.collect() if r.doc_id in good and not r.base_failed and r.lang == "en"]
    x, e = (np.array([f(r) for r in own]) for f in (lambda r: math.log2(r.byte_tokens), lambda r: r.byte_entropy))
    assert np.allclose(np.polyfit(x, e, 2)[::-1], bands["en"][1].rise, atol=1e-5) and np.allclose(bands["en"][1].lengths, (x.min(), x.max()))
    low, middle, high = np.quantile([r.byte_chars_per_token for r in own], [0.05, 0.5, 0.95])
    assert np.allclose(bands["en"][1].chars, (middle - max(0.05, 3.5 * (middle - low)), middle + max(0.05, 3.5 * (high - middle))), atol=0.01)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, quality.judged(measured, bands).drop("lang").collect())) == sorted(map(key, quality.quality_rules(docs, bands=bands).collect()))


def test_quality_keeps_good_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1 and toxic = 0")
    rows = queries.op6_quality_rules(spark, SF).join(labels, "doc_id").filter("not base_failed").collect()
    assert rows and all(r.kept for r in rows)


def test_disguised_words_are_restored(spark, docs):
    model = toxicity.character_model(docs.union(spark.createDataFrame([(-1, "you idiot stupid loser moron scum " * 200, "en", "s", 1)], docs.schema)))
    for raw, want in (("i.d.i.o.t", "idiot"), ("$tupid", "stupid"), ("m0r0n", "moron"), ("looooser", "loser"), ("st*pid", None), ("s-c-u-m", "scum")):
        got = toxicity.restore(toxicity.stripped(raw), model)
        assert want is None or got == want
    assert "idiot" in toxicity.Restorer(model).words("an i d i o t here") and not toxicity.disguised("plain")


def test_restored_words_are_the_best_of_their_lattice(spark, docs):
    import itertools

    model = toxicity.character_model(docs)
    rng = random.Random(8)

    def cost(path):
        total, a, b = sum(c for _, c in path), 0, 0
        for letter in "".join(x for x, _ in path):
            n = toxicity._number(letter)
            total -= float(model.log[a, b, n])
            a, b = b, n
        return total - float(model.log[a, b, 0])

    for _ in range(400):
        word = "".join(rng.choice("aetnils013.$!-@tt") for _ in range(rng.randint(1, 7)))
        paths = itertools.product(*toxicity.hypotheses(word))
        best = min((round(cost(p), 9), "".join(x for x, _ in p)) for p in paths)
        got = toxicity.restore(word, model)
        assert abs(min(cost(p) for p in itertools.product(*toxicity.hypotheses(word)) if "".join(x for x, _ in p) == got) - best[0]) < 1e-6


def test_disguises_at_a_words_ends(spark, docs):
    assert [toxicity.stripped(w) for w in ("1d10+", "$7up1d", "(hello)!", "well...", "100%", "+++")] == ["1d10+", "$7up1d", "(hello", "well", "100", ""]
    model = toxicity.character_model(docs.union(spark.createDataFrame([(-1, "you idiot stupid loser " * 300, "en", "s", 1)], docs.schema)))
    restorer = toxicity.Restorer(model)
    assert [restorer.word(w) for w in ("1d10+", "$7up1d", "stuupid")] == ["idiot", "stupid", "stupid"]
    long = "i.d.i.o.t" * 50_000
    assert len(restorer.words(long + " " + "x " * 20_000)) < 200_000 // toxicity.PIECE


def test_toxicity_weights_and_bias():
    model = toxicity.ToxicityModel(toxicity.CharacterModel({}), {"bad": (40, 1), "rare": (3, 0)}, (50, 400), -4.0)
    assert model.weight("bad") == pytest.approx(math.log(40.5 / 51) - math.log(1.5 / 401)) and model.weight("other") == 0
    assert model.weight("bad", 0) > model.weight("bad") and model.weight("rare", 1) == 0 < model.weight("rare")
    sums, toxic = np.array([0.0] * 90 + [12.0] * 9 + [0.0]), np.array([False] * 90 + [True] * 10)
    low = toxicity.fitted_bias(sums, toxic, 0.1)
    like = lambda b: float(np.where(toxic, -np.log1p(np.exp(-sums - b)), -np.log1p(np.exp(sums + b))).sum())
    assert all(like(low) >= like(x) - 1e-9 for x in np.arange(-9, 3, 0.1))
    # Where most texts without a weight are toxic the bias is above any constant's.
    assert toxicity.fitted_bias(np.zeros(100), np.arange(100) < 80, 0.8) == pytest.approx(math.log(4), abs=1e-3)
    assert toxicity.fitted_bias(np.zeros(3), np.zeros(3, bool), 0.0) == toxicity.cautious_bias(np.zeros(3), np.zeros(3, bool), 0.0) == toxicity.NO_BIAS
    # Ten times the rows, a smaller step down; of texts without weights it is that of a share's log odds.
    steps = [toxicity.fitted_bias(np.zeros(n), np.arange(n) < n // 10, 0.1) - toxicity.cautious_bias(np.zeros(n), np.arange(n) < n // 10, 0.1) for n in (100, 1000)]
    assert steps[0] == pytest.approx(toxicity.CAUTION / math.sqrt(100 * 0.09), rel=1e-3) and steps[1] == pytest.approx(steps[0] / math.sqrt(10), rel=1e-3)


def test_blanks_in_words_are_left_out_and_borders_kept(spark, docs):
    plain = " ".join(["you are a stupid idiot and i am not sure what he said to the man in the house so it is a good day"] * 300)
    model = toxicity.character_model(docs.union(spark.createDataFrame([(-1, plain, "en", "s", 1)], docs.schema)))
    restorer = toxicity.Restorer(model)
    for text, want in (("you are a s t u p i d i d i o t", {"stupid", "idiot"}), ("I s t u p i d", {"stupid"}), ("you stu pid man", {"stupid"}), ("such a st upid day", {"stupid"}), ("so s tupid it is", {"stupid"}), ("an id iot he is", {"idiot"}), ("s.t.u p 1 d", {"stupid"})):
        assert want <= restorer.words(text), (text, restorer.words(text))
    for text in ("he is in the man a day", "i am a man", "it is so good to me"):
        assert restorer.words(text) == set(text.split()), text
    rng = random.Random(4)
    pieces = ["".join(rng.choice("stupidare") for _ in range(rng.randint(1, 4))) for _ in range(5000)]
    assert all(len(x) <= 2 * toxicity.PIECE for x in restorer.spaced(pieces)) and restorer.words(" ".join(pieces))


def test_the_best_borders_of_short_pieces(spark, docs):
    """Every way to keep or leave out the blanks of a stretch, tried out."""
    import itertools

    model = toxicity.character_model(docs)
    rng = random.Random(12)
    for _ in range(120):
        stretch = " ".join("".join(rng.choice("aetnilsh") for _ in range(rng.choice([1, 1, 2, 3]))) for _ in range(rng.randint(2, 4)))
        costs = {}
        for path in itertools.product(*toxicity.hypotheses(stretch)):
            total, a, b, text = sum(c for _, c in path), 0, 0, "".join(x for x, _ in path)
            for letter in [*text, ""]:
                n = toxicity._number(letter) if letter.strip() else 0
                total -= float(model.log[a, b, n])
                a, b = b, n
            costs[text] = min(total, costs.get(text, total))
        assert costs[toxicity.restore(stretch, model)] - min(costs.values()) < 1e-6


def test_toxicity_learns_and_generalises(spark, edges):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op7_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    bad, good = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    assert len(bad) >= 5 and sum(bad) / len(bad) > 0.5 and sum(good) / len(good) < 0.1
    for d, lab in ((edges, labels.filter("false")), (edges.filter("false"), labels)):
        model = toxicity.fit_toxicity(d, lab)
        scored = toxicity.score_toxicity(d, model).collect()
        assert len(scored) == d.count() and all(0 <= r.score < 0.5 for r in scored)


def plain_sentences(text):
    """Sentences by walking the text: up to a line's end, or to . ! ? before white space."""
    out, own = [], ""
    for k, c in enumerate(text):
        own += c
        if c == "\n" or (c in ".!?" and (k + 1 == len(text) or text[k + 1].isspace())):
            if own.strip():
                out.append(own)
            own = ""
    return out + [own] * bool(own.strip())


def brute_passages(rows, run, min_words, split=None):
    split = {k: (split or (lambda t: substring_dedup.sentences(t)[1]))(t or "") for k, (_, t) in enumerate(rows)}
    seen, covered = set(), {k: set() for k in split}
    for k in sorted(split, key=lambda k: rows[k][0]):
        parts = [" ".join(s.lower().split()) for s in split[k]]
        for p in range(len(parts) - run + 1):
            if sum(len(s.split()) for s in parts[p : p + run]) >= min_words:
                key = tuple(parts[p : p + run])
                if key in seen:
                    covered[k] |= set(range(p, p + run))
                seen.add(key)
    return {rows[k][0]: len(c) for k, c in covered.items()}


def test_passages_against_brute_force(spark, edges):
    rng = random.Random(2)
    sentence = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(3, 40))) + rng.choice([". ", "!\n", "? "])
    passage = "".join(sentence() for _ in range(6))
    rows = []
    for i in range(40):
        own = [sentence() for _ in range(rng.randint(0, 6))]
        if i % 4 == 0:
            own.insert(rng.randint(0, len(own)), passage)
        rows.append((i, "".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.dedup_substrings(df).collect()
    assert {r.doc_id: r.n_removed for r in got} == brute_passages(rows, 3, 1)
    short = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(5, 15))) + rng.choice([". ", "!\n", "? "])
    shared = [short() for _ in range(5)]
    apart = [(i, "".join([short() for _ in range(rng.randint(0, 4))] + shared * (i % 3 == 0) + [short() for _ in range(rng.randint(0, 4))])) for i in range(30)]
    found = {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(spark.createDataFrame(apart, "doc_id long, text string")).collect()}
    assert found == brute_passages(apart, 3, 1, plain_sentences) and sum(x > 0 for x in found.values()) == 9
    plain = dict(rows)
    for r in got:
        assert (r.kept == plain[r.doc_id]) == (r.n_removed == 0)
    assert next(r for r in got if r.doc_id == 0).n_removed == 0 and sum(r.n_removed > 0 for r in got) == 9
    assert substring_dedup.dedup_substrings(edges).count() == len(EDGES) and substring_dedup.dedup_substrings(edges.filter("false")).count() == 0


def test_short_passages_and_short_tails_go(spark):
    """Sentences of one to four words, alone and behind longer ones, against a plain splitting of its own."""
    rng = random.Random(9)
    sentence = lambda lo, hi: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(rng.randint(lo, hi))).capitalize() + rng.choice([". ", "! ", "?\n"])
    short, tail = [sentence(2, 2) for _ in range(5)], [sentence(8, 12), *(sentence(1, 3) for _ in range(5))]
    rows = [(i, "".join([sentence(4, 9) for _ in range(3)] + shared + [sentence(4, 9) for _ in range(3)])) for i, shared in enumerate([short, tail, [], short, tail, [], short + tail])]
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_passages(rows, 3, 1, plain_sentences) == {0: 0, 1: 0, 2: 0, 3: 5, 4: 6, 5: 0, 6: 11}


def test_passages_of_short_sentences(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    for most in (1, 2, 3):
        passage = "".join(" ".join(word() for _ in range(rng.randint(1, most))) + rng.choice([". ", "!\n"]) for _ in range(60))
        rows = [(i, f"{word()} {word()} own text. {passage}{word()} ends here.") for i in range(3)]
        got = {r.doc_id: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert [got[i].n_removed for i in range(3)] == [0, 60, 60]


def test_passages_without_spaces(spark):
    rng = random.Random(6)
    letters = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    passage = letters(400)
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(spark.createDataFrame([(i, letters(90 + i) + passage + letters(90)) for i in range(8)], "doc_id long, text string")).collect()}
    assert got[0].n_removed == 0 and all(sum(len(x.text) for x in got[i].removed) > 300 for i in range(1, 8))


@pytest.mark.parametrize("space", [" ", "\t"])
def test_passages_at_all_offsets(spark, space):
    rng = random.Random(4)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]
    passage = words(60)
    rows = [(i, space.join(words(20 + i) + passage + words(25)) + ".") for i in range(17)]
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_removed == 0 and all(40 <= got[i].removed_words <= 60 for i in range(1, 17))


def test_sentences_are_the_text():
    rng = random.Random(0)
    for _ in range(3000):
        t = "".join(rng.choice("ab c.\n!? é　\x1c") for _ in range(rng.randint(0, 80)))
        head, parts = substring_dedup.sentences(t, 3)
        assert head + "".join(parts) == t


def test_context_tree_is_a_distribution_and_follows_the_definition():
    rng = np.random.default_rng(0)
    count = Counter(b"\0" + bytes(rng.choice(list(b"abc"), rng.integers(1, 5)).tolist()) for _ in range(40))
    words = list(count)
    word, byte, keys = ctw.contexts(words)
    c = np.array([count[w] for w in words])
    parts = [(keys[d][keys[d] >= 0], byte[keys[d] >= 0], c[word[keys[d] >= 0]]) for d in range(ctw.DEPTH + 1)]
    tree = ctw.weigh(*(np.concatenate([p[k] for p in parts]).astype(t) for k, t in ((0, np.int64), (1, np.int64), (2, float))))
    assert np.allclose((10.0 ** tree.table.astype(float)).sum(1), 1, atol=1e-5)

    def log_kt(items):
        b = sum(bit for _, bit in items)
        a = len(items) - b
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def weighted(items, d=0):
        children = {}
        for ctx, bit in items:
            children.setdefault(ctx[d] if d < min(ctw.DEPTH, len(ctx)) else None, []).append((ctx, bit))
        if set(children) == {None}:
            return log_kt(items)
        return np.logaddexp(log_kt(items), sum(weighted(v, d + 1) if k is not None else log_kt(v) for k, v in children.items())) - math.log(2)

    nodes = {}
    for w, n in count.items():
        s = w[:1] + b" " + w[1:] + b" "
        for i in range(2, len(s)):
            node = 1
            for k in range(7, -1, -1):
                bit = s[i] >> k & 1
                nodes.setdefault(node, []).extend([(s[:i][::-1], bit)] * n)
                node = 2 * node + bit
    log, node = 0.0, 1
    for k in range(7, -1, -1):
        bit = ord("a") >> k & 1
        log += weighted(nodes[node] + [(b" \0", bit)]) - weighted(nodes[node])
        node = 2 * node + bit
    assert abs(tree.word_scores([b"\0a"])[0] - (log / math.log(10) + tree.table[np.searchsorted(tree.keys, ord("a") | 0x20 << 8 | 3 << 56), 0x20])) < 1e-3


def test_language_model_base_scores(spark, edges):
    rows = texts()
    count = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(ctw.tokens(t.encode()))
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in queries.op9_context_tree(spark, SF).collect()}
    for i, t in rows:
        own = ctw.tokens(t.encode())
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[w] > 0 for w in own), n)
        assert abs(r.base_score - sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)) < 1e-6 * len(own)
        assert r.score < 0 and r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
    assert ctw.score_texts(edges).count() == len(EDGES) and ctw.score_texts(edges.filter("false")).count() == 0


def whole_tree_scores(rows, hold_out=(7, 2)):
    """Scores under the tree of all contexts, held whole."""
    count = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % hold_out[0] != hold_out[1]:
            s = b" " * ctw.DEPTH + ctw.stream(t.encode())
            count.update((s[k - d : k], s[k]) for k in range(ctw.DEPTH, len(s)) for d in range(ctw.DEPTH + 1))
    key = lambda c: int.from_bytes(c[::-1], "little") | len(c) << 56 if c else 0
    tree = ctw.weigh(np.array([key(c) for c, _ in count]), np.array([b for _, b in count]), np.array(list(count.values()), float))
    at = {k: n for n, k in enumerate(tree.keys.tolist())}
    out = {}
    for i, t in rows:
        s = b" " * ctw.DEPTH + ctw.stream(t.encode())
        out[i] = sum(float(tree.table[next(at[key(s[k - d : k])] for d in range(ctw.DEPTH, -1, -1) if key(s[k - d : k]) in at), s[k]]) for k in range(ctw.DEPTH, len(s)))
    return len(at), out


def test_context_tree_keeps_every_context(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 40)))) for i in range(48)]
    n, expected = whole_tree_scores(rows)
    assert n > 12_288
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (16 << 20, 500):
        got = ctw.score_texts(df, block=block).collect()
        assert len(got) == len(rows) and {r.held_out for r in got} == {False, True}
        for r in got:
            assert abs(r.score - expected[r.doc_id]) < 1e-4 * abs(expected[r.doc_id])
            assert abs(r.bits_per_byte * len(ctw.stream(dict(rows)[r.doc_id].encode())) * math.log10(2) + r.score) < 1e-6 * abs(r.score)


def test_context_tree_sees_words_before(spark):
    rows = [(i, "one two three four five six seven " * 5) for i in range(20)] + [(100, "one two three four five six seven"), (101, "seven five two six one four three")]
    got = {r.doc_id: r for r in ctw.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].n_tokens == got[101].n_tokens and got[100].score > got[101].score + 1


def test_quality_classifier_on_held_out_rows(spark, edges):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op10_quality_classifier(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    for d, lab in ((edges, labels.filter("false")), (edges.filter("false"), labels)):
        trees = classifier.fit_quality(d, lab)
        scored = classifier.score_quality(d, trees).collect()
        assert len(scored) == d.count() and all(0 <= r.score <= 1 for r in scored)


def test_flat_trees_equal_walking_them():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(classifier.STATISTICS)))
    y = (x[:, 0] + x[:, 1] ** 2 > 1).astype(float)
    trees = classifier.fit_trees(x, y, rounds=12)
    for row, m in zip(x[:50], trees.margin(x[:50]), strict=True):
        total = trees.base
        for at in trees.roots:
            while trees.child[at] >= 0:
                at = trees.child[at] + (row[trees.feature[at]] > trees.threshold[at])
            total += trees.value[at]
        assert abs(total - m) < 1e-9
    assert (trees.probability(x) > 0.5).astype(float).tolist() == pytest.approx(y.tolist(), abs=1) and ((trees.probability(x) > 0.5) == y).mean() > 0.9


def test_digest_columns_of_queries(spark):
    row = {r.doc_id: r for r in queries.op1_byte_bpe(spark, SF).collect()}
    media_row = {r.doc_id: r for r in queries.op5_media_columns(spark, SF).collect()}
    for i, t in texts():
        p = media.payload_of(t.encode())
        assert row[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert media_row[i].payload_sha256 == hashlib.sha256(p).hexdigest() and media_row[i].tail_crc32 == zlib.crc32(p[-32:])
        assert (media_row[i].n_bytes, media_row[i].payload_bytes) == (len(t.encode()), len(p))


def test_similar_documents_equal_sql(spark):
    assert rows_of(queries.op4_ngram_jaccard(spark, SF)) == duck_rows(queries.SQL["op4_ngram_jaccard"], SF)


def test_long_runs_and_long_words():
    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    ours, whole = bpe.ByteBPE(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), packing.DocumentTokens(path, ranks)
    rng = random.Random(7)
    for t in (" " * 1_000_000, "x" + " \n" * 300_000 + "y", "".join(rng.choices("abcdefgh漢字", k=1_500_000))):
        assert ours.decode(ours.encode([t])[0]) == t.encode()
        assert ours.encode([t])[0] == ours.encode_chunks([t])[0] and len(whole.encode([t])[0]) > 0
    assert all(len(k) <= 64 for x in (ours.cache, whole.cache) for k in (*x.known, *x.before))
    for t in (" " * 5000, "a" * 3000, "x" + "\n " * 1500 + "y"):  # as long as tiktoken's matcher takes
        tok = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
        assert np.frombuffer(whole.encode([t])[0], "<u4").tolist() == tok.encode_ordinary(t)
    f = quality.Fertility((public_tokenizers.path("piece_bpe_32k.model"),))
    assert f.measures({"a" * 100_000: 1, "b": 2}, 100_002)[0][0] > 1000 and all(len(k) <= 64 for k in f.known)


def test_equal_rows_are_dealt_over_shards(spark):
    df = spark.createDataFrame([(1, "the same row")] * 10_000, "doc_id long, text string")
    rows = packing.pack(packing.token_pieces(df), shard=1000).collect()
    shards = Counter(r.sequence_id // packing.SHARD_STRIDE for r in rows)
    assert len(rows) == 10_000 and len(shards) == 10 and max(shards.values()) < 1300


def test_sum_of_squares_against_trying_every_bin():
    rng = random.Random(9)
    for capacity in (8, 30):
        lengths = sorted((rng.randint(1, capacity) for _ in range(120)), reverse=True)
        gaps, want = [], []  # gaps[k] is what sequence k has left
        squares = lambda g: sum(n * n for k, n in Counter(g).items() if 0 < k < capacity)
        for n in lengths:
            fits = sorted({g for g in gaps if g >= n})
            if fits and n < capacity:
                best = min(fits, key=lambda g: (squares([x for k, x in enumerate(gaps) if k != gaps.index(g)] + [g - n]), g))
                gaps[gaps.index(best)] -= n
                want.append(capacity - best)
            else:
                gaps.append(capacity - n)
                want.append(0)
        _, offset = packing.sum_of_squares(np.array(lengths), capacity)
        assert offset.tolist() == want


def test_first_tree_against_plain_split_search():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, size=(200, 3)).astype(float)
    y = ((x[:, 1] > 5) ^ (rng.random(200) < 0.1)).astype(float)
    trees = classifier.fit_trees(x, y, rounds=1, depth=1)
    p = y.mean()
    g, h = y - p, np.full(len(y), p * (1 - p))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 2.0)
    cuts = [(score(x[:, k] <= c) + score(x[:, k] > c), k, c) for k in range(3) for c in np.unique(x[:, k]) if 10 <= (x[:, k] <= c).sum() <= 190]
    best = max(c[0] for c in cuts)
    k, c = int(trees.feature[0]), trees.threshold[0]
    assert abs(score(x[:, k] <= c) + score(x[:, k] > c) - best) < 1e-9
    for side, at in ((x[:, k] <= c, trees.child[0]), (x[:, k] > c, trees.child[0] + 1)):
        assert trees.value[at] == pytest.approx(0.15 * g[side].sum() / (h[side].sum() + 2.0))


def test_tiles_hold_something_and_similar_sets_share_one():
    rng = np.random.default_rng(6)
    for size in (7, 12, 40, 300):
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
            b = a.copy()
            while True:
                c = np.unique(np.append(np.delete(b, rng.integers(len(b))), rng.integers(0, 1 << 63, rng.integers(0, 2), np.uint64)))
                if 100 * len(np.intersect1d(a, c)) < 80 * len(np.union1d(a, c)):
                    break
                b = c
            assert set(jaccard.tiles(a, 80)) & set(jaccard.tiles(b, 80))
        sets = [np.unique(rng.integers(0, 1 << 63, size, np.uint64)) for _ in range(1500)]
        # Tiles of empty parts would be shared by unrelated sets.
        count = Counter(t for s in sets for t in set(jaccard.tiles(s, 80).tolist()))
        assert max(count.values()) <= 1


def test_long_texts_are_hashed_in_pieces():
    words = [str(k * k % 9973) for k in range(200_000)]
    text = " ".join(words).encode()
    assert len(text) > 2 * jaccard.SLICE
    (whole,) = jaccard.shingle_sets([text], 5)
    parts = [jaccard.shingle_sets([" ".join(words[k : k + 20_004]).encode()], 5)[0] for k in range(0, 200_000, 20_000)]
    assert whole.tolist() == np.unique(np.concatenate(parts)).tolist()
    assert [len(x) for x in jaccard.shingle_sets([text, b"", b"a" * (1 << 20), b"a b"], 5)] == [len(whole), 0, 1, 1]


def test_a_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace

    from momentloom.llm.common import checkpoint_dir

    made = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda *a: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None))
    for master in ("yarn", "spark://a:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            checkpoint_dir(made(master, None))
        assert checkpoint_dir(made(master, "hdfs://x")) == "hdfs://x"
    assert checkpoint_dir(made("local[4]", None))


def test_groups_of_blocks_are_summed_in_one_pass():
    """Blocks of like and unlike keys: sums and places are those of plain dictionaries; bytes and time follow the blocks."""
    import time

    import pyarrow as pa

    rng = np.random.default_rng(5)

    def table(blocks, shared):
        rows = []
        for b in range(blocks):
            k = np.unique(rng.integers(0, 1 << 62, 2000, np.uint64) if not shared else rng.integers(0, 3000, 2000, np.uint64) << np.uint64(20))
            rows.append((b, k, rng.integers(0, 5, len(k))))
        return rows, pa.table({"g": pa.array([3] * blocks, pa.int32()), "b": pa.array(range(blocks), pa.int32()), "keys": pa.array([ctw.packed(k) for _, k, _ in rows]), "n": pa.array([ctw.packed(n) for _, _, n in rows])})

    for shared in (False, True):
        rows, t = table(40, shared)
        out = ctw._summed_group((pa.scalar(3),), t).to_pylist()[0]
        keys, n = ctw.unpacked(out["keys"], np.uint64), ctw.unpacked(out["n"], np.int64)
        want = Counter()
        for _, k, c in rows:
            for x, y in zip(k.tolist(), c.tolist(), strict=True):
                want[x] += y
        assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == dict(want)
        for (b, k, _), place in zip(rows, out["places"], strict=True):
            assert keys[ctw.unpacked_places(place, len(keys))].tolist() == k.tolist()
    took = {}
    for blocks in (60, 240):
        _, t = table(blocks, False)
        began = time.process_time()
        out = ctw._summed_group((pa.scalar(3),), t)
        took[blocks] = time.process_time() - began, sum(len(x) for x in out["places"][0].as_py())
    assert took[240][0] < 9 * took[60][0] and took[240][1] < 6 * took[60][1]


def test_caches_of_workers_are_freed():
    from momentloom.llm import common

    paths = (public_tokenizers.path("piece_bpe_32k.model"),)
    first = quality.fertility(paths)
    assert quality.fertility(paths) is first
    common.free_caches()
    assert quality.fertility(paths) is not first and quality.fertility(paths).measures({"word": 2}, 8) == first.measures({"word": 2}, 8)
