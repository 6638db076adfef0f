"""Quality rules, language model, classifier and language identification."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.llm import language_id, language_model, quality_classifier, quality_rules, queries

DATA = Path("/root/testdata/sf0.01")
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_rules(t):
    w = words(t)
    lines = [x for x in (t or "").split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


TEXTS = [
    None, "", " \n\t ", "\n\n", "a\na\n a\nA\n", "x y z x y z x y", "é ñ 漢字 #|<>$%&*", "one two three", "same line\nsame line\nsame line", "a b c\n" * 60, "end\n",
    "w " * 5000, "\x0b\x0c\r", "zwei\r\nzwei\r\n",
]


VOCABS = [queries.vocabulary(v) for v in ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")]


def brute_verdict(t, lang, bands):
    """Measures under both vocabularies, word by word, and whether they lie in the bands."""
    from routeloom.llm import kernels as K

    out, fine = [], True
    lead = Counter(quality_rules.SCRIPTS[k] for k in quality_rules._SCRIPT_OF[np.frombuffer((t or "").encode(), np.uint8)] if k)
    script = min(lead, key=lambda s: (-lead[s], quality_rules.SCRIPTS.index(s))) if lead else "none"
    assert K is not None
    for path, own in zip(VOCABS, bands, strict=True):
        v = quality_rules.vocabulary(path)
        ids = [i for w in words(t) for i in v.encode([w])[0]]
        n, raw = len(ids), sum(bool(v.is_byte[i]) for i in ids)
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values()) if n else 0.0
        out.append((n, raw, round(entropy, 6)))
        b = own.get(lang) or own.get(script)
        if b is None or not n:
            fine = False
            continue
        per = sum(map(len, words(t))) / n
        fine &= b.centre - b.slack - b.noise / math.sqrt(n) <= per <= b.most and raw / n <= b.byte_share and (n < 2 or entropy / math.log2(n) >= b.evenness)
    return out, script, fine


def all_bands():
    own = quality_rules.Rules().bands
    return [own[p.rsplit("/", 1)[-1]] | {s: own[p.rsplit("/", 1)[-1]].get(s) or quality_rules.script_band(p, s) for s in quality_rules.SCRIPTS[1:]} for p in VOCABS]


def test_verdicts_against_brute_force(spark):
    rnd = random.Random(8)
    samples = ["the quick river runs over quiet stones and", "der Fluss und die Berge sind alt", "река течёт через старый город", "η πόλη και το ποτάμι είναι", "הנהר והעיר הם ישנים", "النهر والمدينة قديمة", "नदी और शहर पुराने हैं", "かわ と まち は ふるい です", "河 城 市 山 水 人 大 小", "강 과 도시 는 오래된", "zxqj kvw pfgh bdrt", "$$$ ### 12 99", "aaa"]
    texts = [None, "", *(" ".join(rnd.choice(s.split()) for _ in range(rnd.choice([20, 60, 300]))) for s in samples for _ in range(4)), "x" * 1_000_000, "漢字 " * 30_000]
    rows = [(i, t, rnd.choice(["en", "de", None, "ru"])) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), VOCABS).collect()}
    bands = all_bands()
    for i, t, lang in rows:
        measures, script, fine = brute_verdict(t, lang, bands)
        r = got[i]
        assert [(f["n_tokens"], f["byte_tokens"], round(f["entropy"], 6)) for f in r["fertility"]] == measures and r["script"] == script, i
        assert r["fertile"] == fine and r["kept"] == (fine and not r["base_failed"]), (i, t and t[:40])


def test_script_bands_follow_the_vocabulary():
    for p in VOCABS:
        for s in quality_rules.SCRIPTS[2:]:
            b = quality_rules.script_band(p, s)
            assert 0.1 < b.centre <= 0.8 and 0.1 <= b.byte_share <= 1.0


def test_lines_and_words_of_one_polynomial_hash(spark):
    from tests.llm.test_dedup import thue_morse

    x, y = thue_morse(1024)
    df = spark.createDataFrame([(1, f"{x}\n{y}"), (2, f"{x}\n{x}"), (3, f"{x} a b {y} a b")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.judge(df, VOCABS, lang_col=None).collect()}
    assert got == {1: (0, 0), 2: (1, 0), 3: (0, 0)}


def test_rules_against_brute_force(spark):
    rnd = random.Random(1)
    texts = TEXTS + ["".join(rnd.choice("ab #\n") for _ in range(rnd.randint(0, 300))) for _ in range(100)]
    df = spark.createDataFrame([(i, t, rnd.choice(["en", None, "xx"]), "n") for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words string")
    got = {r["doc_id"]: r for r in quality_rules.judge(df, VOCABS).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        want = brute_rules(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, repr(t)[:80]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r["kept"] or not r["base_failed"])
    assert quality_rules.judge(df.where("false"), VOCABS).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_rules_keep_clean_texts(spark):
    got = queries.op6_quality_rules(spark, str(DATA)).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("not base_failed")
    good, bad = got.where("quality = 1"), got.where("quality = 0")
    assert good.where("kept").count() / good.count() > 0.97 and bad.where("not kept").count() / bad.count() > 0.3


def brute_model(rows, is_trained, is_held):
    """Base columns and score of every row from dictionaries of whole n-grams."""
    streams = [(i, [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(FOLD)), None]) for i, t in rows]

    def counted(use):
        c = [Counter(), Counter(), Counter()]
        texts = 0
        for i, ws in streams:
            if use(i):
                texts += 1
                seq = ["START", *ws]
                for k in range(1, len(seq)):
                    c[0][seq[k]] += 1
                    c[1][tuple(seq[k - 1 : k + 1])] += 1
                    if k > 1:
                        c[2][tuple(seq[k - 2 : k + 1])] += 1
        c[0]["START"] = texts
        return c, sum(n for w, n in c[0].items() if w != "START"), sum(1 for w, n in c[0].items() if w != "START" and n), texts

    full, part = counted(is_trained), counted(lambda i: is_trained(i) and not is_held(i))

    def estimates(seq, k, counts):
        c, n, v, _ = counts
        asked2 = full[0][0][seq[k - 1]] >= 2 and full[0][0][seq[k]] >= 1
        before = full[0][1][tuple(seq[k - 2 : k])] if k > 1 and full[0][0][seq[k - 2]] >= 2 and full[0][0][seq[k - 1]] >= 1 else 0
        asked3 = asked2 and k > 1 and before >= 2 and full[0][1][tuple(seq[k - 1 : k + 1])] >= 1
        p, row = [1 / (v + 1), c[0][seq[k]] / max(1, n), 0.0, 0.0], 0
        if c[0][seq[k - 1]] >= 2:
            p[2] = c[1][tuple(seq[k - 1 : k + 1])] / c[0][seq[k - 1]] if asked2 else 0.0
            row = 96 + int(language_model.bucket(np.array([c[0][seq[k - 1]]]))[0])
        ctx = c[1][tuple(seq[k - 2 : k])] if k > 1 and before else 0
        if ctx >= 2:
            p[3] = c[2][tuple(seq[k - 2 : k + 1])] / ctx if asked3 else 0.0
            row = 192 + int(language_model.bucket(np.array([ctx]))[0])
        return p, row

    cells: dict = {}
    for i, ws in streams:
        if is_trained(i) and is_held(i):
            seq = ["START", *ws]
            for k in range(1, len(seq)):
                p, row = estimates(seq, k, part)
                key = row
                for q in p[1:]:
                    key = key * 64 + (min(40, math.floor(-math.log2(q))) if q > 0 else 63)
                n, s = cells.get(key, (0, np.zeros(3)))
                cells[key] = n + 1, s + p[1:]
    keys = np.array(sorted(cells), np.int64)
    w = language_model.learn_weights(keys, np.array([cells[k][0] for k in keys.tolist()], np.int64), np.array([cells[k][1] for k in keys.tolist()]).reshape(-1, 3).T, part[2])
    c, n, v, _ = full
    for i, ws in streams:
        seq, total = ["START", *ws], 0.0
        for k in range(1, len(seq)):
            p, row = estimates(seq, k, full)
            total += math.log10(sum(a * b for a, b in zip(p, w[row], strict=True)))
        base = sum(math.log10((c[0][x] + 0.1) / (n + 0.1 * (v + 1))) for x in ws)
        yield (i is None, i or 0, len(ws), sum(c[0][x] > 0 for x in ws), round(base, 6), round(total, 6)), n


@pytest.mark.parametrize("block", [300, 2 << 20])
def test_language_model_against_brute_force(spark, monkeypatch, block):
    from routeloom.llm import blocks
    from tests.llm.test_dedup import thue_morse

    monkeypatch.setattr(blocks, "BLOCK_BYTES", block)
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["the", "The", "cat", "sat", "mat", "on", f"w{rnd.randint(0, 30)}"]) for _ in range(rnd.randint(0, 40))) for _ in range(160)]
    x, y = thue_morse(1024)
    rows = [*enumerate(texts), (500, None), (501, ""), (502, "unseenword"), (502, "unseenword"), (None, "the cat"), (503, f"{x} {x}"), (504, y), (505, "the cat " * 3000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, block string").repartition(5)
    out, total = language_model.score_texts(df, divisor=10, held_out=0)
    got = out.collect()
    assert len(got) == len(rows)
    held = {r["doc_id"] for r in df.where(F.pmod(F.xxhash64("doc_id", F.lit("weights")), F.lit(10)) == 0).select("doc_id").collect()}
    trained = lambda i: (zlib.crc32(str(i).encode()) if i is not None else 0) % 10 != 0
    assert held & {i for i, _ in rows if trained(i)}
    want = list(brute_model(rows, trained, lambda i: i in held))
    assert total == want[0][1]
    mine = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in got)
    for a, (b, _) in zip(mine, sorted(want), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-5 * (1 + abs(b[4])) and abs(a[5] - b[5]) < 1e-5 * (1 + abs(b[5]))
    unseen = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 160 and not trained(r["doc_id"])]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_language_model_of_nothing(spark):
    empty, total = language_model.score_texts(spark.createDataFrame([], "doc_id long, text string"))
    assert total == 0 and empty.count() == 0
    with pytest.raises(ValueError):
        language_model.score_texts(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_weights_are_a_distribution():
    """Weights of every row sum to one and use only the orders that the row has."""
    rng = np.random.default_rng(0)
    rows = np.repeat([3, 96 + 5, 192 + 7], 50)
    cells = np.unique(rows * 64**3 + rng.integers(0, 30, (150, 3)) @ [4096, 64, 1])
    n, sums = rng.integers(1, 50, len(cells)), rng.random((3, len(cells)))
    w = language_model.learn_weights(cells, n, sums, 400)
    assert np.allclose(w.sum(1), 1) and (w >= 0).all() and (w[:, 0] > 0).all() and (w[:96, 2:] == 0).all() and (w[96:192, 3] == 0).all()


def test_features_are_sets():
    from routeloom.llm import kernels as K

    import pyarrow as pa

    texts = pa.array(["abc abc ABC", "", None, "x"])
    for lo, hi, data, offs in K.slabs(texts):
        doc, slot = quality_classifier.features(data, offs, 18)
        assert (lo, hi) == (0, 4) and len(set(zip(doc.tolist(), slot.tolist(), strict=True))) == len(doc) and set(doc.tolist()) == {0, 3}


def test_svm_is_at_the_dual_optimum():
    """On a separable toy set the margin is one for support vectors, and one class or no row has a defined score."""
    rows = quality_classifier.Rows([quality_classifier.packed(np.array(r), 4) for r in ([0, 2], [0, 3], [1, 2], [1, 3])])
    y = np.array([1, 1, -1, -1])
    w, b = quality_classifier.descend(rows, y, np.ones(4), 100.0, 300)
    m = quality_classifier.margins(rows, np.ones(4), w, b)
    assert np.allclose(m * y, 1, atol=1e-2)
    one = quality_classifier.train(rows, np.ones(4), 4)
    assert one[3] == 0.0 and one[4] > 5


def test_feature_rows_of_any_length():
    for slots in (np.zeros(0, np.int64), np.array([3]), np.arange(0, 1 << 10, 2), np.arange(1 << 10)):
        raw = quality_classifier.packed(slots, 10)
        assert quality_classifier.unpacked(raw).tolist() == slots.tolist() and len(raw) <= (1 << 10) // 8 + 1


def brute_features(text, bits):
    """Byte trigrams and word shapes of one text, spelled out."""
    from routeloom.llm import kernels as K

    raw, out = text.encode(), set()
    for i in range(len(raw) - 2):
        out.add((int.from_bytes(raw[i : i + 3], "big") * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits))
    kind, before, last = quality_classifier._KIND, None, None
    for w in re.findall(rb"[^\x20\x09-\x0D]+", raw):
        x = kind[w[0]] * 6 + kind[w[-1]]
        x = (x * 6 + kind[w[max(len(w) - 2, 0)]]) * 2 + (sum(65 <= c <= 90 for c in w) > 1)
        x = int((x * 4 + min(3, len(w) // 4)) * 2 + (w == last))
        mixed = lambda v: int(K.mix(np.array([v % (1 << 64)], np.uint64))[0]) >> (64 - bits)
        out.add(mixed(x + (1 << 40)))
        if before is not None:
            out.add(mixed((x << 20) + before + (1 << 50)))
        before, last = x, w
    return out


def test_classifier_against_a_plain_version(spark):
    """Scores of the operator are those of features, ratios and margins computed one by one."""
    rnd = random.Random(6)
    good, bad = ["calm", "River", "stone", "walks", "quiet,"], ["BUY", "now!!", "$$$", "click", "1000"]
    texts = [" ".join(rnd.choice(good if i % 3 else bad + good[:2]) for _ in range(rnd.randint(1, 30))) for i in range(60)]
    texts += ["calm " * 200_000, "Ünï çödé 漢字"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, label int")
    ratio, w, b, a, c = model = quality_classifier.fit(df, labels, F.lit(True))
    got = {r["doc_id"]: r for r in quality_classifier.score(df, model).collect()}
    sets = [sorted(brute_features(t, 18)) for t in texts]
    counts = {y: Counter(s for i in range(60) if int(i % 3 > 0) == y for s in sets[i]) for y in (0, 1)}
    size = {y: sum(k.values()) + (1 << 18) for y, k in counts.items()}
    for s in sets[0][:20]:
        want = math.log((counts[1][s] + 1) / size[1]) - math.log((counts[0][s] + 1) / size[0])
        assert abs(ratio[s] - want) < 1e-9
    for i, own in enumerate(sets):
        m = sum(ratio[s] * w[s] for s in own) / math.sqrt(sum(ratio[s] ** 2 for s in own)) + b
        assert abs(got[i]["margin"] - m) < 1e-3 and abs(got[i]["score"] - 1 / (1 + math.exp(-(a * m + c)))) < 1e-3
    assert all((got[i]["score"] > 0.5) == (i % 3 > 0) for i in range(60))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_classifier_on_held_out_rows(spark):
    got = queries.op8_quality_classifier(spark, str(DATA)).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in got)
    assert len(got) > 40 and right / len(got) > 0.9


def test_classifier_special_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (2, "", "a"), (None, "text", "a")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([], "doc_id long, label int")
    model = quality_classifier.fit(df, labels, F.lit(True))
    got = quality_classifier.score(df, model).collect()
    assert model is None and [r["score"] for r in got] == [0.5] * 4
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, None)], "doc_id long, label int")
    got = quality_classifier.score(df, quality_classifier.fit(df, labels, F.lit(True))).collect()
    assert all(0 <= r["score"] <= 1 for r in got)


def test_kneser_ney_sums_to_one():
    """Probabilities after any context sum to one over the alphabet and the unseen character."""
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcd e") for _ in range(60)) for _ in range(30)]
    parts = language_id.learn(*language_id.gram_counts(texts, 3))
    chars, _ = language_id.characters(texts)
    alphabet = sorted(set(chars.tolist()))
    model = language_id.Model(["x"], [parts], 3, len(alphabet))
    for context in ("ab", "a ", "da", "cc"):
        total = 0.0
        for c in alphabet:
            codes = np.array([*map(ord, context), c], np.uint32)
            h = language_id.grams(codes, 3)
            total += 2 ** float(model.score(h, np.array([1, 2, 3]))[2, 0])
        assert abs(total - 1) < 1e-3, context


def brute_kneser_ney(texts, order, alphabet):
    """log2 probability of a character after a context, from dictionaries."""
    norm = lambda t: " " + "".join(c if c.isalpha() else "\0" for c in t.lower()) + "\0"
    norm2 = lambda t: re.sub("\0+", " ", norm(t)).replace("  ", " ") if t else " "
    tables, grams = {}, Counter()
    for t in texts:
        s = norm2(t)
        grams.update(s[i : i + order] for i in range(len(s) - order + 1))
    for k in range(order, 0, -1):
        ones, twos = sum(n == 1 for n in grams.values()), sum(n == 2 for n in grams.values())
        tables[k] = dict(grams), ones / (ones + 2 * twos) if ones and twos else 0.5
        grams = Counter(g[1:] for g in grams)

    def p(context, c, k):
        if k == 0:
            return 1 / alphabet
        counts, d = tables[k]
        context = context[len(context) - k + 1 :] if k > 1 else ""
        own = {g: n for g, n in counts.items() if g[:-1] == context}
        below = p(context, c, k - 1)
        if not own:
            return below
        return max(counts.get(context + c, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * below

    def entropy(t):
        s = norm2(t)
        bits = [math.log2(p(s[max(0, i - order + 1) : i], s[i], min(order, i + 1))) for i in range(1, len(s))]
        return -sum(bits) / max(1, len(bits))

    return entropy


def test_entropies_against_a_plain_version():
    rnd = random.Random(9)
    sides = [["".join(rnd.choice(a) for _ in range(rnd.randint(5, 60))) for _ in range(12)] for a in ("abc é1", "abd Éz,", "xyz  ")]
    models = [language_id.learn(*language_id.gram_counts(t, 4)) for t in sides]
    m = language_id.Model(["x", "y", "z"], models, 4, 9)
    texts = [*(t for s in sides for t in s[:2]), "qqq a b", "ab", "a" * 40, None, "", "12 3"]
    got, letters = m.entropies(texts)
    again, _ = language_id.Model.of(m.languages, m.arrays(), 4, 9).entropies(texts)
    assert np.array_equal(got, again) and letters[-3:].tolist() == [0, 0, 0]
    for j, side in enumerate(sides):
        plain = brute_kneser_ney(side, 4, 9)
        for i, t in enumerate(texts[:-3]):
            assert abs(got[i, j] - plain(t)) < 1e-4, (t, j)


def test_many_languages_and_long_texts(spark):
    """300 languages, none left out, in several parts and passes; a training text of 5 MB; a long text is scored whole."""
    rnd = random.Random(4)
    letters = [chr(c) for c in range(0x430, 0x450)] + list("abcdefghijklmnopqrstuvwxyz")
    own = {f"l{k:03d}": rnd.sample(letters, 6) for k in range(300)}
    word = lambda a: "".join(rnd.choice(a) for _ in range(rnd.randint(3, 7)))
    text = lambda a, n: " ".join(word(a) for _ in range(n))
    rows = [(300 * i + k, text(a, 25), lang) for i in range(3) for k, (lang, a) in enumerate(own.items())]
    long = text(own["l007"], 2000)
    rows += [(9000, (long + " ") * (5_000_000 // len(long.encode()) + 1), "l007"), (9001, (long + " ") * 60, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    once = language_id.fit(df, F.lit(True))
    assert len(once.bounds) == 300 and len(once.sizes) >= 300 // 16 and sum(1 for _ in once.loads()) == 1
    split = language_id.Fitted(once.parts, once.order, once.alphabet, once.sizes, sum(x[2] for x in once.sizes) // 3, once.bounds)
    assert sum(1 for _ in split.loads()) >= 3
    probe = df.where("doc_id >= 9001 or doc_id % 13 = 0")
    got = [{r["doc_id"]: r for r in language_id.identify(probe, f).collect()} for f in (once, split)]
    assert len(got[0]) > 60 and got[0][9001]["lang_pred"] == "l007"
    right = sum(got[0][i]["lang_pred"] == lang for i, _, lang in rows if i % 13 == 0 and lang and i < 9000)
    assert right / (len(got[0]) - 1) > 0.97
    for i, r in got[0].items():
        assert (r["lang_pred"], r["rejected"]) == (got[1][i]["lang_pred"], got[1][i]["rejected"]) and abs(r["score"] - got[1][i]["score"]) < 1e-9


def test_sorted_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.int64).astype(np.uint64) * np.uint64(2))
    s = language_id.Sorted(keys)
    assert (s.find(keys) == np.arange(len(keys))).all() and (s.find(keys + np.uint64(1)) == -1).all()


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_languages_on_held_out_rows(spark):
    got = queries.op10_language_id(spark, str(DATA)).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.97 and sum(r["rejected"] for r in got) / len(got) < 0.01


def test_language_special_rows(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 !!", "en"), (103, "the dog", None), (103, "the dog", None), (None, "die katze", "de"), (104, "漢字" * 300, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    fitted = language_id.fit(df, F.lit(True))
    got = language_id.identify(df, fitted, carry=True).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["rejected"] and by[i]["score"] == 0 for i in (100, 101, 102))
    assert by[103]["lang_pred"] == "en" and by[None]["lang_pred"] == "de" and not by[103]["rejected"] and by[104]["rejected"]
    none = language_id.identify(df, language_id.fit(df, F.lit(False))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert language_id.identify(df.where("false"), fitted).count() == 0
