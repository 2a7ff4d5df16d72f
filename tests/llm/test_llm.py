import collections
import hashlib
import random

import numpy as np
import pytest

TOK = "/opt/tokenizers"
WORDS = ["the", "old", "mill", "stands", "by", "river", "and", "turns", "all", "day", "long", "grain", "is", "ground", "there", "for", "bread", "men", "sing"]


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) + str(rng.randrange(90)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [text(rng, rng.randrange(20, 200)) for _ in range(40)]
    near = []
    for t in base[:12]:
        w = t.split()
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    odd = [None, "", " \n ", "one", "ü漢字 \U0001f600 x", "a" * 500, text(rng, 6000), base[0] + " " + base[1]]
    return [(k, t, "en") for k, t in enumerate(base + near + base[:3] + odd)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_encoder_equals_tokenizer(rows):
    from tokenizers import Tokenizer

    from winnow.llm.packing import Encoder

    e, t = Encoder(f"{TOK}/byte_bpe_50k.json"), Tokenizer.from_file(f"{TOK}/byte_bpe_50k.json")
    for x in [*[r[1] or "" for r in rows], "<|endoftext|>a", "a\t\tb \n\n c", "don't 12 3.4", "x\x85y z"]:
        assert e.encode(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing(docs, empty):
    from winnow.llm.packing import best_fit_pack, plan_patterns

    got = best_fit_pack(docs, f"{TOK}/byte_bpe_50k.json").collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}
    assert best_fit_pack(empty, f"{TOK}/byte_bpe_50k.json").count() == 0
    rng = random.Random(1)
    hist = collections.Counter(rng.randrange(1, 65) for _ in range(3000))
    plans = plan_patterns(hist, 64)
    used = collections.Counter()
    for runs, n in plans:
        assert sum(length * m for length, m in runs) <= 64
        for length, m in runs:
            used[length] += m * n
    assert used == hist
    assert sum(n for _, n in plans) <= 1.02 * sum(k * v for k, v in hist.items()) / 64 + 1


def test_near_duplicates(docs, rows, empty):
    from winnow.llm.dartminhash import near_duplicates

    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().split()
        k = min(5, len(w))
        sets[i] = collections.Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else collections.Counter({(): 1})
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = sum((sets[a] & sets[b]).values())
            if a < b and both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both):
                x, y = root[a], root[b]
                for i in root:
                    if root[i] == max(x, y):
                        root[i] = min(x, y)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == root
    assert near_duplicates(empty).count() == 0


def test_repeated_strings(docs, rows, empty):
    from winnow.llm.sadedup import remove_repeats

    got = {r.doc_id: r for r in remove_repeats(docs).collect()}
    seen = set()
    for i, t, _ in rows:
        b = (t or "").encode()
        out = [False] * len(b)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                out[s : s + 100] = [True] * 100
            seen.add(b[s : s + 100])
        kept = bytes(x for x, o in zip(b, out, strict=True) if not o)
        spans = sum(o and (k == 0 or not out[k - 1]) for k, o in enumerate(out))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(out), spans, hashlib.sha256(kept).hexdigest())
    assert remove_repeats(empty).count() == 0


def test_language(spark, empty):
    from winnow.llm.langid import learn_prototypes, predict_language

    rng = random.Random(2)
    words = {"en": ["the", "and", "thing", "with"], "de": ["der", "und", "nicht", "schön"]}
    data = [(k, " ".join(rng.choice(words[x]) for _ in range(12)), x) for k in range(40) for x in [rng.choice(["en", "de"])]]
    df = spark.createDataFrame(data + [(90, None, "en"), (91, "12 !", None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in predict_language(df, learn_prototypes(df)).collect()}
    assert all(out[k].lang_pred == x for k, _, x in data)
    assert out[90].lang_pred == out[91].lang_pred == "und"
    assert learn_prototypes(empty) == {}


def test_toxicity(spark, empty):
    from winnow.llm.toxicity import learn, score_toxicity

    rng = random.Random(3)
    data = []
    for k in range(300):
        bad = k % 6 == 0
        data.append((k, text(rng, 30) + (" vile scoundrel" if bad else " "), int(bad)))
    df = spark.createDataFrame([*data, (900, None, None)], "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in score_toxicity(df, learn(df.where("toxic is not null"))).collect()}
    assert all(got[k].predicted == y for k, _, y in data) and got[900].predicted == 0
    none = learn(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert 0 <= score_toxicity(empty, none).count() == 0


def test_urls(spark):
    from winnow.llm.urlfilter import RULES, judge_urls

    urls = ["http://WWW.Example.com/en/1?x", "https://a.example.com/en/", "http://example.com/de/", "ftp://x.net/es/#t", "http://com", "no scheme", None, "http:///en/", "http://net/fr/a", "http://badexample.com/en/"]
    got = {r.url: (r.host, r.rule, r.verdict) for r in judge_urls(spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string"), RULES).collect()}
    assert [got[u][1:] for u in urls] == [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), ("net/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("net/fr/", "block"), ("com/", "allow")]


def test_vectors(spark):
    from winnow.llm.lsh import near_duplicate_vectors

    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 64))
    vecs = [*base, *(base[:20] + rng.normal(size=(20, 64)) * 0.08), *base[:5]]
    data = [(k, [float(np.float32(x)) for x in v], k % 2 if k < 60 else (k - 60) % 2 if k < 80 else (k - 80) % 2) for k, v in enumerate(vecs)]
    data += [(200, None, 1), (201, [0.0] * 64, 1), (202, [float("nan")] * 64, 1), (203, data[0][1], None)]
    got = {r.vec_id: r for r in near_duplicate_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect()}
    for a, v, x in data[:85]:
        near = [b for b, w, y in data[:85] if a != b and x == y and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98]
        assert got[a].n_links == len(near)
        assert got[a].component_id == min([a, *near])
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in (200, 201, 202, 203))


def test_fingerprints(docs, rows, empty):
    from winnow.llm.omh import edited_fingerprints

    got = {r.doc_id: r for r in edited_fingerprints(docs).collect()}
    same = {}
    for k, (i, t, _) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert same.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert np.mean([got[i].near_edited for i in range(40)]) > 0.25 > 0.1 > np.mean([got[i].near_next for i in range(40)])
    assert edited_fingerprints(empty).count() == 0


def test_sentencepiece(docs, rows):
    from winnow.llm.spm import MARK, NONE, Pieces, encode_documents

    p = Pieces(f"{TOK}/piece_bpe_32k.model")
    assert all(r.round_trip for r in encode_documents(docs, f"{TOK}/piece_bpe_32k.model").collect())
    for s in [MARK + "abcdefgh1" * 90, *[(" " + (r[1] or "")).replace(" ", MARK) for r in rows[:5]]]:
        best = [0.0] + [NONE] * len(s)
        for j in range(1, len(s) + 1):
            best[j] = max(best[i] + p._arc(s[i:j]) for i in range(max(0, j - p.longest), j))
        path = p._giant(s)
        assert "".join(path) == s and sum(p._arc(x) for x in path) == best[-1]


def test_lm(spark):
    from winnow.llm.lm import stupid_backoff

    df = spark.createDataFrame([(1, "a b a b"), (2, "a c"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in stupid_backoff(df).collect()}
    p = lambda *x: round(float(np.log(x).sum()), 4)
    assert got[1].log_score == p(3 / 6, 2 / 3, 0.4 * 3 / 6, 2 / 3) and got[2].log_score == p(3 / 6, 0.4 / 6)
    assert got[3].n_words == 0 and got[3].mean_log_score is None


def test_lm_lots(spark, rows, empty, monkeypatch):
    """Many lots and ranges, windows inside texts, null and repeated ids,
    repeated rows and clashing columns, against a direct count."""
    from winnow.llm import lm

    monkeypatch.setattr(lm, "LOT_BYTES", 4000)
    monkeypatch.setattr(lm, "RANGE_BYTES", 9000)
    data = [(k, t, "a") for k, t, _ in rows] + [(None, rows[0][1], "b"), (None, "x y", "b"), (3, "\t x\x0by\r\nx  y\x0c", "c"), (3, "\t x\x0by\r\nx  y\x0c", "c")]
    df = spark.createDataFrame(data, "doc_id long, text string, lot string").selectExpr("doc_id", "text", "lot", "1 AS id", "2 AS part")
    split = [[w for w in (t or "").translate(str.maketrans("\t\n\r\f\v", "     ")).split(" ") if w] for _, t, _ in data]
    one = collections.Counter(w for ws in split for w in ws)
    two = collections.Counter(p for ws in split for p in zip(ws, ws[1:]))  # noqa: B905
    want = []
    for (k, _, _), ws in zip(data, split, strict=True):
        p = [np.log(two[a, b] / one[a]) if two[a, b] > 1 else np.log(0.4 * one[b] / one.total()) for a, b in zip(ws, ws[1:])]  # noqa: B905
        p = [np.log(one[ws[0]] / one.total()), *p] if ws else []
        want.append((-1 if k is None else k, len(ws), float(sum(p))))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.log_score) for r in lm.stupid_backoff(df).collect())
    want.sort()
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-3 for g, w in zip(got, want, strict=True))
    assert lm.stupid_backoff(empty).count() == 0
    texts = [t.encode() for t in ("a b", "", "cc a", " ", "b" * 50 + " a")]
    whole = lm.token_hashes(texts)
    monkeypatch.setattr(lm, "WINDOW", 3)
    assert all((a == b).all() for a, b in zip(whole, lm.token_hashes(texts), strict=True))


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    pieces = c.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_pipeline_language_floor(spark):
    """Long texts in unlearned scripts and languages and letter junk go; clean texts of one word stay."""
    import corpus_pipeline as c

    rng = random.Random(6)
    junk = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))
    foreign = {
        "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Stary młyn stoi nad rzeką i obraca się przez cały dzień, a ludzie z wioski przynoszą tam zboże na mąkę i chleb.",
        "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Il vecchio mulino sta vicino al fiume e gira tutto il giorno, mentre la gente del paese porta il grano per fare il pane.",
        "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Vanha mylly seisoo joen rannalla ja pyörii koko päivän, kun kylän väki tuo sinne viljaa leipää varten.",
        "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    }
    scripts = ["αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщ", "".join(map(chr, range(0x4E00, 0x55D0))), "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"]
    bad = [*foreign.values(), *(junk(s, 500) for s in scripts for _ in range(5))]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    learned = [r.text for r in docs.where("text rlike '[[:alpha:]]'").collect()]
    words = collections.Counter(w for t in learned for w in t.split() if w.isalpha() and len(w) >= 4)
    good = [w for w, _ in words.most_common(20)]
    more = [(10**9 + k, t, None) for k, t in enumerate(bad + good)]
    out = {r.doc_id for r in c.language_id(spark, docs.unionByName(spark.createDataFrame(more, docs.schema)), "").collect()}
    assert not [t[:40] for k, t, _ in more[: len(bad)] if k in out]
    assert [t for k, t, _ in more[len(bad) :] if k in out] == good
    assert {r.doc_id for r in docs.where("text rlike '[A-Za-z]'").collect()} <= out


def test_fingerprints_are_order_minhash(spark):
    """Halves of short texts swapped: the likeness is that of the least two of all elements, kept in text order."""
    from pyspark.sql import functions as F

    from winnow.llm.omh import likeness, signature

    rng, dice = random.Random(9), np.random.default_rng(9)
    for n in (10, 20, 60):
        data, want = [], []
        for _ in range(100):
            w = [str(x) for x in rng.sample(range(10**6), n)]
            sides = [w, w[n // 2 :] + w[: n // 2]]
            data.append([" ".join(x) for x in sides])
            at = [{p: k for k, p in enumerate(zip(x, x[1:]))} for x in sides]  # noqa: B905
            for _ in range(32):
                rank = dict(zip({**at[0], **at[1]}, dice.random(2 * n), strict=False))
                first, second = (sorted(sorted(side, key=rank.get)[:2], key=side.get) for side in at)
                want.append(first == second)
        got = spark.createDataFrame(data, "a string, b string").select(likeness(signature(F.col("a")), signature(F.col("b"))).alias("x")).collect()
        assert abs(np.mean([r.x for r in got]) - np.mean(want)) < 0.06


def test_lm_orders(spark, rows, monkeypatch):
    """Orders 1 to 4 and several cutoffs, over many lots, against the recursion of the definition."""
    from winnow.llm import lm

    monkeypatch.setattr(lm, "LOT_BYTES", 6000)
    monkeypatch.setattr(lm, "RANGE_BYTES", 20000)
    data = [(k, t) for k, t, _ in rows] + [(500, "a b a b"), (501, "a b c"), (502, "z"), (503, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    split = {k: (t or "").split() for k, t in data}
    counts = collections.Counter(tuple(w[i : i + n]) for w in split.values() for n in (1, 2, 3, 4) for i in range(len(w) - n + 1))
    total = sum(map(len, split.values()))

    def score(g, cutoff):
        if len(g) == 1:
            return counts[g] / total
        return counts[g] / counts[g[:-1]] if counts[g] >= cutoff else 0.4 * score(g[1:], cutoff)

    for order, cutoff in ((1, 1), (2, 1), (3, 1), (3, 2), (4, 3)):
        got = {r.doc_id: r for r in lm.stupid_backoff(df, order=order, cutoff=cutoff).collect()}
        for k, w in split.items():
            want = sum(np.log(score(tuple(w[max(0, i - order + 1) : i + 1]), cutoff)) for i in range(len(w)))
            assert got[k].n_words == len(w) and abs(got[k].log_score - want) < 1e-3


def test_lm_memory(rows):
    """What a worker holds of a lot in each of the three steps, in bytes a word; scores against the definition."""
    import tracemalloc

    import pyarrow as pa

    from winnow.llm import lm

    rng = random.Random(23)
    texts = [t for _, t, _ in rows] + [text(rng, 100_000) for _ in range(3)]
    lot = pa.table({"id": range(len(texts)), "text": texts, "lot": [7] * len(texts)})
    split = [(t or "").split() for t in texts]
    n_words = sum(map(len, split))

    def held(f, *tables):
        tracemalloc.start()
        out = f(*tables)
        assert tracemalloc.get_traced_memory()[1] < 100 * n_words
        tracemalloc.stop()
        return out

    lm.list_grams(1, 2)(lot.slice(0, 9))  # the powers of the hash are kept
    lists = held(lm.list_grams(3, 2), lot)
    answers = pa.concat_tables([lm.answer(3)(lists.slice(k, 1)) for k in (2, 0, 1)])
    held(lm.answer(1), lm.list_grams(1, 2)(lot))
    got = held(lm.score_lot(2, 2, pa.int64()), lot, answers).to_pylist()
    one = collections.Counter(w for ws in split for w in ws)
    two = collections.Counter(p for ws in split for p in zip(ws, ws[1:]))  # noqa: B905
    for r, ws in zip(got, split, strict=True):
        p = [two[a, b] / one[a] if two[a, b] > 1 else 0.4 * one[b] / n_words for a, b in zip(ws, ws[1:])]  # noqa: B905
        assert r["k"] == len(ws) and abs(r["s"] - np.log([one[w] / n_words for w in ws[:1]] + p).sum()) < 1e-3


def test_sentencepiece_ids_equal_library(spark, docs):
    import sentencepiece

    from winnow.llm.spm import encode_documents

    model = f"{TOK}/piece_bpe_32k.model"
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rng = random.Random(4)
    odd = ["des les Elle", " a  b ", "\t x\n\ny", "a▁b ▁▁", "a\0b c", "\x85 ü漢字\U0001f600", "aaaaaaaaa" * 90, "".join(rng.choice("abcder,.1é") for _ in range(3000)), "don't,stop!x;y", "<s>x</s>", "   ", "ﬁ Å"]
    tables = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10**9 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    both = tables.unionByName(docs.selectExpr("doc_id + 1000000 AS doc_id", "text")).unionByName(more)
    text_of = {r.doc_id: r.text or "" for r in both.collect()}
    for r in encode_documents(both, model).collect():
        assert r.ids == sp.encode(text_of[r.doc_id]), text_of[r.doc_id][:60]
        assert r.n_tokens == len(r.ids)


def test_too_many_languages(spark, monkeypatch):
    from winnow.llm import langid

    df = spark.createDataFrame([("the mill", "a"), ("die Mühle", "b"), ("le moulin", "c")], "text string, lang string")
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    assert sorted(langid.learn_prototypes(df)) == ["a", "b", "c"]
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        langid.learn_prototypes(df)


def test_encoder_long_runs():
    """Runs of two million blanks, line ends and letters, in and around text, against the tokenizer."""
    from tokenizers import Tokenizer

    from winnow.llm.packing import LONG_BLANKS, Encoder

    e, t = Encoder(f"{TOK}/byte_bpe_50k.json"), Tokenizer.from_file(f"{TOK}/byte_bpe_50k.json")
    runs = [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, " \n\t" * 700_000]
    short = [" " * n + c for n in (LONG_BLANKS - 1, LONG_BLANKS, LONG_BLANKS + 1) for c in ("", "x", "!", "\n")]
    for x in [*runs, runs[0] + "x", "say" + runs[1] + " the mill" + runs[3] + "!", "漢" + runs[0] + "x", *short, *(a + b for a in short[:5] for b in short[5:])]:
        assert e.encode(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_rows(spark, rows):
    """Every returned column against the tokenizer, with null and repeated ids and rows and a blank run of a million."""
    import zlib

    from tokenizers import Tokenizer

    from winnow.llm.packing import best_fit_pack

    t = Tokenizer.from_file(f"{TOK}/byte_bpe_50k.json")
    data = [(k, x, "a", 1) for k, x, _ in rows] + [(None, "x y", "b", 2)] * 300 + [(3, "again", "c", 3)] * 2 + [(900, "a" + " " * 1_000_000 + "b", "d", 4)]
    df = spark.createDataFrame(data, "doc_id long, text string, salt string, length int")
    want = collections.Counter()
    for k, x, _, _ in data:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        first = len(ids) - (-(-len(ids) // 2048) - 1) * 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        for p, (lo, hi) in enumerate(zip(edges, edges[1:])):  # noqa: B905
            want[k, p, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())] += 1
    got = best_fit_pack(df, f"{TOK}/byte_bpe_50k.json").collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048


def test_fingerprints_of_repeated_ids(spark):
    from winnow.llm.omh import edited_fingerprints

    data = [(1, "one two three four"), (2, "five six seven eight nine"), (2, "five six seven eight nine"), (2, "another text under this id"), (3, ""), (3, None), (None, "no id here at all"), (None, None)]
    got = edited_fingerprints(spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS next", "2 AS tail", "3 AS t")).collect()
    sizes = lambda x: collections.Counter(x)
    assert sizes((r.doc_id, r.n_chars) for r in got) == sizes((k, len(t or "")) for k, t in data)
    tails = {r.edited_sha256 for r in got if r.doc_id == 1}
    assert len(tails) == 1 and tails <= {hashlib.sha256((data[0][1][:14] + t[:4]).encode()).hexdigest() for t in (data[1][1], data[3][1])}
    assert {r.edited_sha256 for r in got if r.doc_id == 2} == {hashlib.sha256((t[: len(t) - len(t) // 4]).encode()).hexdigest() for t in (data[1][1], data[3][1])}
    assert len({r.fingerprint for r in got if r.doc_id == 2}) == 2


def test_fingerprints_write_no_table(spark, tmp_path, monkeypatch):
    """Many null ids, repeated ids and a pair of documents: rows and likenesses, with nothing written on the way."""
    from pyspark.sql import functions as F

    from winnow import storage
    from winnow.llm.omh import edited_fingerprints, likeness, shown, signature

    monkeypatch.setattr(storage, "shared_dir", lambda _: str(tmp_path))
    rng = random.Random(29)
    base = [text(rng, 30) for _ in range(4)]
    data = [(None, base[0])] * 50 + [(None, None)] * 3 + [(-7, base[1]), (4, base[2]), (4, base[2]), (9, base[3]), (9, base[0]), (2**62, base[1])]
    got = edited_fingerprints(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert not list(tmp_path.iterdir())
    assert collections.Counter((r.doc_id, r.n_chars) for r in got) == collections.Counter((k, len(t or "")) for k, t in data)
    texts = spark.createDataFrame([(t,) for t in ["", *base]], "t string").select("t", F.xxhash64("t").alias("h"), signature(F.col("t")).alias("s"))
    prints = {r.t: r.f for r in texts.select("t", shown(F.col("s")).alias("f")).collect()}
    pairs = texts.alias("a").crossJoin(texts.alias("b")).select(F.col("a.t").alias("t"), F.col("b.t").alias("u"), F.col("b.h"), likeness(F.col("a.s"), F.col("b.s")).alias("x")).collect()
    alike, hashes = {(r.t, r.u): r.x for r in pairs}, {r.u: r.h for r in pairs}
    later = {-7: 4, 4: 9, 9: 2**62, 2**62: -7}
    first = {k: min((t for i, t in data if i == k), key=hashes.get) for k in later}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    cut = lambda t: t[: len(t) - len(t) // 4]
    want = [(k, prints[t or ""], 0.0 if k is None else alike[t, first[later[k]]], sha(cut(t or "") + ("" if k is None else first[later[k]][: len(t) // 4]))) for k, t in data]
    assert collections.Counter((r.doc_id, r.fingerprint, r.near_next, r.edited_sha256) for r in got) == collections.Counter(want)
    assert edited_fingerprints(spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")).count() == 1


CLASH = ["text_", "t", "id", "row", "lang_pred", "score", "n_grams", "predicted", "host", "rule", "verdict", "hit_verdict", "best", "kept_", "gone_", "__text", "__kept", "__gone"]


def test_clashing_columns(spark, rows):
    """Columns of any name beside the needed ones change nothing."""
    from winnow.llm.langid import learn_prototypes, predict_language
    from winnow.llm.toxicity import Model, score_toxicity
    from winnow.llm.urlfilter import RULES, judge_urls

    df = spark.createDataFrame([(k, t, "en") for k, t, _ in rows], "doc_id long, text string, lang string")
    wide = df.selectExpr("*", *[f"{k} AS `{c}`" for k, c in enumerate(CLASH)])
    protos = learn_prototypes(wide)
    for f in (lambda d: predict_language(d, protos).select("doc_id", "lang_pred", "score"), lambda d: score_toxicity(d, Model([], np.zeros(0), 0.5)).select("doc_id", "score", "predicted")):
        assert sorted(f(wide).collect()) == sorted(f(df).collect())
    assert {"text", "hit_verdict", "row"} <= set(score_toxicity(wide, Model([], np.zeros(0), 0.5)).columns)
    pages = df.selectExpr("doc_id AS page_id", "concat('http://a.example.com/en/', doc_id) AS url").unionByName(spark.createDataFrame([(-1, None), (None, "")], "page_id long, url string"))
    both = [judge_urls(d, RULES).select("page_id", "host", "path", "rule", "verdict") for d in (pages, pages.selectExpr("*", *[f"{k} AS `{c}`" for k, c in enumerate(CLASH)]))]
    assert sorted(map(str, both[0].collect())) == sorted(map(str, both[1].collect()))
    none = judge_urls(pages.where("false"), RULES)
    assert none.count() == 0 and none.columns == ["page_id", "url", "host", "path", "rule", "verdict"]


def test_label_model_outweighs_wrong_labels():
    """Voters that agree win over labels of which a tenth are wrong."""
    from winnow.llm.toxicity import label_model

    rng = np.random.default_rng(4)
    truth = rng.random(3000) < 0.2
    fires = np.where(truth[:, None], rng.random((3000, 8)) < 0.5, rng.random((3000, 8)) < 0.02).astype(float)
    given = np.where(rng.random(3000) < 0.1, ~truth, truth).astype(float)
    found = label_model(fires, given) > 0.5
    assert (found == truth).mean() > 0.97 > 0.92 > (given == truth).mean()


def test_vectors_of_any_size(spark, empty):
    """Components near the ends of doubles, several widths, an empty table and repeated rows."""
    from winnow.llm.lsh import hashes_for, near_duplicate_vectors

    rng = np.random.default_rng(5)
    v, w = rng.normal(size=16), rng.normal(size=5)
    data = [(1, (v).tolist(), 1), (2, (v * 1e300).tolist(), 1), (3, (v * 1e-300).tolist(), 1), (4, (-v).tolist(), 1), (5, (w).tolist(), 1), (6, (w * 2.5).tolist(), 1), (6, (w * 2.5).tolist(), 1), (7, [], 1), (None, (v).tolist(), 1), (8, [1.0, None], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS id", "2 AS codes")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in near_duplicate_vectors(df).collect())
    assert got == [(-1, 0, None), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (5, 2, 5), (6, 2, 5), (6, 2, 5), (7, 0, 7), (8, 0, 8)]
    assert near_duplicate_vectors(df.where("false")).count() == 0
    assert [hashes_for(n, 64) for n in (0, 10**4, 10**6, 10**9)] == [2, 2, 3, 4]


def test_vector_recall(spark):
    """At every number of hashes, of pairs at a cosine of exactly 0.98 nine in ten meet."""
    from winnow.llm.lsh import _unit, codes

    rng = np.random.default_rng(6)
    for dim in (64, 300):
        a = _unit(rng.normal(size=(500, dim)))
        r = rng.normal(size=(500, dim))
        b = 0.98 * a + np.sqrt(1 - 0.98**2) * _unit(r - (r * a).sum(1, keepdims=True) * a)
        for hashes in (2, 3, 4, 5):
            x, y = codes(a, hashes=hashes), codes(b, hashes=hashes)
            assert ((x[:, :, :1] == y) | (y[:, :, :1] == x)).any((1, 2)).mean() >= 0.95


def test_vector_recall_with_a_last_hash(spark):
    """Likewise at every width of a last hash over some of the axes, which cuts buckets evenly."""
    from winnow.llm.lsh import LOAD, _sides, _unit, codes, hashes_for, last_axes

    rng = np.random.default_rng(7)
    for dim in (5, 64, 300):
        for n in (0, 1, 10**3, 10**4, 5 * 10**4, 10**7, 10**10):
            hashes = hashes_for(n, dim)
            last = last_axes(n, dim, hashes)
            buckets = _sides(dim) ** hashes * max(1, 2 * last)
            assert buckets < 2**62 and (buckets >= n / LOAD or 2 * last == _sides(dim) or buckets * 2 > 2**61)
            assert last == 0 or buckets <= 2 * n / LOAD
        a = _unit(rng.normal(size=(500, dim)))
        r = rng.normal(size=(500, dim))
        b = 0.98 * a + np.sqrt(1 - 0.98**2) * _unit(r - (r * a).sum(1, keepdims=True) * a)
        for hashes, last in ((2, 1), (2, 2), (2, 4), (2, 8), (3, 1), (3, 4)):
            x, y = codes(a, hashes=hashes, last=last), codes(b, hashes=hashes, last=last)
            assert ((x[:, :, :1] == y) | (y[:, :, :1] == x)).any((1, 2)).mean() >= 0.95
            assert len(np.unique(x[:, 0, 0])) >= len(np.unique(codes(a, hashes=hashes)[:, 0, 0]))


def test_repeated_strings_of_hot_anchors(spark, monkeypatch):
    """One passage in hundreds of different texts, more than a batch sends to a bucket; texts under one id."""
    from winnow.llm import sadedup

    monkeypatch.setattr(sadedup, "HOT", 2)
    rng = random.Random(11)
    passage = text(rng, 30)
    data = [(k, text(rng, rng.randrange(5, 40)) + " " + passage[rng.randrange(20) :] + " " + text(rng, 20)) for k in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r for r in sadedup.remove_repeats(df).collect()}
    seen = set()
    for i, t in data:
        b = t.encode()
        out = [False] * len(b)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                out[s : s + 100] = [True] * 100
            seen.add(b[s : s + 100])
        assert (got[i].n_removed, got[i].kept_sha256) == (sum(out), hashlib.sha256(bytes(x for x, o in zip(b, out, strict=True) if not o)).hexdigest())
    twice = spark.createDataFrame([(1, passage), (1, passage), (1, passage + " and more"), (1, None), (None, passage)], "doc_id long, text string").selectExpr("*", "1 AS tag", "2 AS runs")
    rows = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in sadedup.remove_repeats(twice).collect())
    n = len(passage.encode())
    assert [r[:2] for r in rows] == [(-1, n), (1, 0), (1, n), (1, n), (1, n + 9)]
    assert rows[0][2] == 0 and rows[2][2] == rows[3][2] and {rows[2][2], rows[4][2]} == {0, n}


def test_repeated_strings_of_long_texts(docs, monkeypatch):
    """What a worker holds of a text of megabytes; small segments and lots against brute force; no table of the last level."""
    import tracemalloc

    import pandas as pd
    import pyarrow as pa

    from winnow.llm import sadedup

    levels = (sadedup.anchor_runs, sadedup.short_runs, sadedup.single_windows)
    raw, more = np.random.default_rng(3).integers(97, 123, 4_000_000, dtype=np.uint8), ()
    for level in levels:
        tracemalloc.start()
        at = []
        for got in level(raw, *more):
            at.append(got["at"].copy())
            del got
        assert tracemalloc.get_traced_memory()[1] < 200e6
        tracemalloc.stop()
        more = (np.concatenate(at),)
        assert sadedup._split(more[0])[2].sum() == len(raw) - 99

    for name, value in (("SEGMENT", 300), ("LOT", 20), ("HOT", 2)):
        monkeypatch.setattr(sadedup, name, value)
    rng = random.Random(17)
    passage = text(rng, 300)
    data = [text(rng, 60) + passage[rng.randrange(900) :][: rng.randrange(1000)] + text(rng, rng.randrange(90)) for _ in range(30)]
    gone = [np.zeros(len(t), bool) for t in data]
    runs = None
    for level in levels:
        given = [k for k in range(len(data)) if runs is None or runs[k]]
        columns = [pa.array(given), pa.array([data[k] for k in given]), pa.array([5] * len(given)), *([pa.array([runs[k] for k in given])] if runs else [])]
        batches = list(sadedup._make(level, 1)(iter([pa.RecordBatch.from_arrays(columns, names=["doc", "t", "tag", "runs"][: len(columns)])])))
        assert len(batches) > 5
        done = sadedup._settle_bucket(pd.concat([b.to_pandas() for b in batches]))
        runs = [done["at"][(done.kind == 2) & (done.doc == k)].tolist() for k in range(len(data))]
        for k in range(len(data)):
            gone[k] |= sadedup.cover(len(data[k]), done["at"][(done.kind == 1) & (done.doc == k)].to_numpy().view(np.uint64))
    seen = set()
    for t, got in zip(data, gone, strict=True):
        out = np.zeros(len(t), bool)
        for s in range(len(t) - 99):
            out[s : s + 100] |= t[s : s + 100] in seen
            seen.add(t[s : s + 100])
        assert (got == out).all()

    tables = []
    monkeypatch.undo()
    monkeypatch.setattr(sadedup, "durable", lambda df, write=sadedup.durable: tables.append(write(df)) or tables[-1])
    assert sadedup.remove_repeats(docs).count() == docs.count() and len(tables) == 2


def test_near_duplicates_of_repeated_ids(spark, rows, monkeypatch):
    """Null ids, repeated rows, an id with two texts, clashing columns, heavy weights and small blocks."""
    from winnow.llm import dartminhash as d

    monkeypatch.setattr(d, "BLOCK", 3)
    a, b = rows[30][1], rows[31][1]
    near = " ".join(w if k != 5 else "else" for k, w in enumerate((a + " " + a).split()))
    heavy = "round and " * 4000
    data = [(1, a + " " + a), (1, a + " " + a), (2, near), (3, b), (4, None), (5, ""), (None, a), (None, None), (6, a + " " + a), (6, b), (7, heavy), (8, heavy + "round about")]
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in d.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS band", "2 AS sig")).collect())
    assert got == collections.Counter([(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 4, False), (None, None, True), (None, None, True), (6, 1, False), (6, 3, False), (7, 7, True), (8, 7, False)])


def test_dart_signatures_estimate_similarity():
    from winnow.llm.dartminhash import K, signatures, similarity

    rng = np.random.default_rng(8)
    for n in (1, 40, 3000):
        for top in (1, 50):
            keys = np.sort(rng.integers(0, 1 << 63, n + n // 4 + 1).astype(np.uint64))
            x, y = ((keys[s], rng.integers(1, top + 1, n).astype(np.int64)) for s in (slice(0, n), slice(len(keys) - n, None)))
            a, b, c = signatures([x, y, x])
            assert (a == c).all()
            assert abs((a == b).mean() - similarity(x, y)) < 5 * np.sqrt(0.25 / K)


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Every stage's rows, one by one, over a table with planted toxic, foreign, copied and repeated
    passages, nulls, repeated rows and clashing names."""
    import corpus_pipeline as c
    from winnow.llm import langid, toxicity
    from winnow.llm.queries import labelled

    sf = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 20000")
    given = base.collect()
    long_one = next(r for r in given if r.lang == "en" and len((r.text or "").split()) > 150)
    passage = " ".join(long_one.text.split()[:70])
    near = long_one.text.split()
    near[20] = "altered"
    junk = " ".join("".join(random.Random(k).choice("αβγδεζηθ") for _ in range(6)) for k in range(300))
    planted = [(10**6, " ".join(near)), (10**6 + 1, junk), (10**6 + 2, "Quite another matter was told that day: " + passage), (10**6 + 3, None), (10**6 + 4, ""), (10**6 + 5, "12 34 !"), (None, "the old mill stands by the river and the men sing all day long")]
    more = spark.createDataFrame([(k, t, "en", "src9", len(t or "")) for k, t in planted], base.schema)
    docs = base.unionByName(more).selectExpr("*", "doc_id % 3 AS `row`", "1 AS kept", "2 AS n_removed", "3 AS kept_text", "4 AS text_", "5 AS `__kept`")
    docs = docs.unionByName(docs.where("doc_id = 1000000")).cache()
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or "")
    rows_of = lambda df: sorted(map(key, df.collect()))

    model = toxicity.learn(labelled(spark, docs, sf))
    first = c.toxicity(spark, docs, sf)
    lexicon = frozenset(model.voters)
    assert first.columns == docs.columns
    assert rows_of(first) == sorted(key(r) for r in docs.collect() if model.score(*toxicity.votes(r.text, lexicon)) < toxicity.THRESHOLD)

    protos = langid.learn_prototypes(docs.where(~c.held_out()).select("text", "lang"))
    space, want = langid.Space(), []
    for r in docs.collect():
        codes, counts = np.unique(langid.gram_codes(r.text), return_counts=True)
        if len(codes):
            v = sum(int(n) * space.vector(int(x)).astype(np.int64) for x, n in zip(codes, counts, strict=True))
            best = max(float(p @ v / np.linalg.norm(v)) for p in protos.values())
            if best >= max(0.04, min(0.35, 0.04 + 0.002 * (len(codes) - 30))):
                want.append(key(r))
    second = c.language_id(spark, docs, sf)
    assert second.columns == docs.columns and rows_of(second) == sorted(want)
    gone = {k for k, _ in set(rows_of(docs)) - set(rows_of(second))}
    assert {10**6 + 1, 10**6 + 3, 10**6 + 4, 10**6 + 5} <= gone and long_one.doc_id not in gone

    third = c.minhash(spark, docs, sf)
    sets = {}
    for r in docs.where("doc_id is not null").collect():
        w = (r.text or "").encode().split()
        n = min(5, len(w))
        sets[r.doc_id] = collections.Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if w else collections.Counter([()])
    root = {i: i for i in sets}
    sizes = {i: sum(s.values()) for i, s in sets.items()}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b]) and root[a] != root[b]:
                both = sum((sets[a] & sets[b]).values())
                if both >= 0.8 * (sizes[a] + sizes[b] - both):
                    x, y = sorted((root[a], root[b]))
                    root = {i: x if r == y else r for i, r in root.items()}
    assert sorted(k for k, _ in rows_of(third)) == [-1, *sorted(set(root.values()))]
    assert root[10**6] == root[long_one.doc_id]

    fourth = c.suffix_array(spark, third, sf)
    seen, want = set(), []
    for k, t in sorted(rows_of(third)):
        b = t.encode()
        out = np.zeros(len(b), bool)
        for s in range(len(b) - 99) if k >= 0 else ():
            if b[s : s + 100] in seen:
                out[s : s + 100] = True
            seen.add(b[s : s + 100])
        want.append((k, np.frombuffer(b, np.uint8)[~out].tobytes().decode("utf-8", "ignore")))
    assert fourth.columns == docs.columns and rows_of(fourth) == want
    assert passage not in dict(want)[10**6 + 2] and all(r.n_chars == len(r.text) for r in fourth.where("doc_id = 1000002").collect())

    last = c.packing(spark, fourth, sf)
    from winnow.llm.packing import Encoder

    e = Encoder(f"{TOK}/byte_bpe_50k.json")
    assert {r.doc_id: r.n for r in last.groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect() if r.doc_id} == {k: len(e.encode(t)) // 4 + 1 for k, t in want if k > 0}
    none = docs.where("false")
    for _, stage in c.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_sentencepiece_scan_of_words_and_giants(rows):
    """Paths of short words and of giants, over many chunks, have the best sum of a direct programme."""
    from winnow.llm.spm import MARK, NONE, Pieces, prefixes, product

    p = Pieces(f"{TOK}/piece_bpe_32k.model")
    rng = random.Random(12)

    def best(s):
        most = [0.0] + [NONE] * len(s)
        for j in range(1, len(s) + 1):
            most[j] = max(most[i] + p._arc(s[i:j]) for i in range(max(0, j - p.longest), j))
        return most[-1]

    words = [MARK + w for w in {w for r in rows for w in (r[1] or "").split()} if len(w) < 40][:300] + [MARK + "漢字ü", "\U0001f600"]
    p.cache.clear()
    p._words(words)
    for w in words:
        ids, sums = np.frombuffer(p.cache[w], "<u4").tolist(), best(w)
        assert p.decode(ids) == w.replace(MARK, " ")[1:] or MARK not in w
        if not any(i in p.of_byte for i in ids):
            assert abs(sum(p.score[p.text[i]] for i in ids) - sums) < 1e-9
    giant = "".join(rng.choice("abcdefg.h1") for _ in range(5000))
    path = p._giant(giant)
    assert "".join(path) == giant and abs(sum(map(p._arc, path)) - best(giant)) < 1e-6
    ms = [np.array([[rng.random() for _ in range(3)] for _ in range(3)]) for _ in range(13)]
    one = ms[0]
    for k, got in enumerate(prefixes(ms)):
        one = product(one, ms[k]) if k else one
        assert np.allclose(got, one)


def test_sentencepiece_rows(spark, empty):
    """Null and repeated ids and rows, a text of a megabyte without a blank, an empty table."""
    import sentencepiece

    from winnow.llm.spm import encode_documents

    model = f"{TOK}/piece_bpe_32k.model"
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rng = random.Random(13)
    long_one = "".join(rng.choice("abcdefgh") for _ in range(1_000_000))
    data = [(1, "the mill"), (1, "the mill"), (1, "other"), (None, "the mill"), (2, None), (3, ""), (4, long_one), (5, "the mill " * 50_000)]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS t")
    got = sorted((r.doc_id or -1, r.n_tokens, r.round_trip) for r in encode_documents(df, model, with_ids=False).collect())
    assert got == sorted((k or -1, len(sp.encode(t or "")), True) for k, t in data)
    assert encode_documents(empty, model).count() == 0
