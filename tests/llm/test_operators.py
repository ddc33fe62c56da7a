"""Operators against plain Python on small tables, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import decontam, embed_dedup, langid, licenses, minhash, mixing, pii, sharding, suffixdedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use for themselves.
CLASHING = ("slot", "shard", "rank", "block", "start", "key", "dkey", "component_id", "n", "score", "dir", "salt", "_copies", "u", "v")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], SCHEMA)


def clashing(df):
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    rows = [words(rng, rng.randrange(3, 200)) for _ in range(60)]
    passage = words(rng, 90, 10**6)
    for i in range(0, 60, 4):
        cut = len(rows[i]) // 2
        rows[i] = rows[i][:cut] + " " + passage + " " + rows[i][cut:]
    rows += [rows[3], rows[3], rows[7].upper(), None, "", " \t\n", "ä" * 500, "ab" * 700, rows[0] + " " + rows[0]]
    long = words(rng, 20000, 10**5)
    rows += [long, long[:90000] + " changed " + long[90000:]]
    near = rows[9].split()
    for i in range(5):
        copy = list(near)
        copy[rng.randrange(len(copy))] = "edited"
        rows.append(" ".join(copy))
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "a b c d", None, None), (None, None, None, None)]
    return clashing(frame(spark, rows)).persist(), rows


def empty(docs):
    return docs.limit(0)


# ---- 1


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m.group())) <= 15]


PERSONAL = [
    "mail a.b@c.de, a@b and x@y.z@w.v or @no.no ü.x@mail.example.com.", "ip 10.0.0.1 1.2.3.4.5 256.1.1.1 001.02.3.4 1.2.3", "card 4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111",
    "call +1 (456) 555-2186, +49 30 1234 or +12345678901234567 ++1 234 567 89", "9" * 3000 + ".1.2.3", "a" * 5000 + "@" + "b." * 2000 + "c", "", None, "@", "+", "1", "+1-", "äö 4111111111111111 ß",
]


def test_pii_base_spans(spark):
    field = pii.Field()
    df = frame(spark, [(i, t, None, None) for i, t in enumerate(PERSONAL)])
    got = {r["doc_id"]: r for r in pii.summary(pii.detect(clashing(df), field)).collect()}
    for i, t in enumerate(PERSONAL):
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(t or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))
        assert got[i]["n_email"] == want.count("email:")
    assert pii.summary(pii.detect(empty(df), pii.learn(empty(df)))).count() == 0


def made_up(rng):
    """A text with personal data of each kind, and numbers that are none."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    card = next(c for c in iter(lambda: "4" + digits(15), None) if pii.luhn(c))
    phone = f"+1 ({digits(3)}) {digits(3)}-{digits(4)}"
    email, ip = f"p.{digits(2)}@mail{digits(1)}.example.com", ".".join(str(rng.randrange(256)) for _ in range(4))
    wrong = next(c for c in iter(lambda: digits(16), None) if not pii.luhn(c))
    return card, phone, email, ip, wrong, f"call {phone} in {rng.randrange(1900, 2030)} or token {digits(6)}x and {wrong} of {email} pay {card} at {ip} version {digits(1)}.{digits(1)} end"


@pytest.fixture(scope="module")
def field():
    rng = random.Random(3)
    return pii.Field().train([pii.Words(*pii.with_echoes(made_up(rng)[-1])) for _ in range(300)])


def test_pii_field_carries_a_number_to_where_it_lacks_its_marks(field):
    text = "call +1 (456) 555-2186 today. many words later: (456) 555-2186 in 1999."
    base, every = pii.find(field, [text])[0]
    assert [text[a:b] for _, a, b in base] == ["+1 (456) 555-2186"]
    assert {text[a:b] for k, a, b in every} == {"+1 (456) 555-2186", "(456) 555-2186"}
    assert pii.redacted(text, every).count("[phone]") == 2


def test_pii_field_finds_what_the_patterns_miss(field):
    """Hand-made truth: weakened forms of each kind, and numbers that are no personal data."""
    rng = random.Random(4)
    right = wrong_ones = missed = 0
    for i in range(120):
        card, phone, email, ip, wrong, text = made_up(rng)
        forms = {
            "card": [".".join(card[k : k + 4] for k in range(0, 16, 4)), f"{card}\v{rng.randrange(10**6, 10**7)}"][i % 2],
            "phone": [phone.partition(" ")[2], f"{phone}\v{rng.randrange(10**6, 10**7)}"][i % 2],
            "email": email.replace("@", ["[at]", "(at)"][i % 2]),
            "ip": ip.replace(".", ["[.]", "-"][i % 2]),
        }
        truth = set()
        for kind, form in forms.items():
            text += f" so {wrong} and "
            truth.add((pii.KINDS.index(kind), len(text), len(text) + len(form.partition("\v")[0])))
            text += form.replace("\v", " ") + f" or {rng.randrange(100)} in"
        base, every = pii.find(field, [text])[0]
        assert not truth & set(base)
        added = set(every) - set(base)
        right, wrong_ones, missed = right + len(added & truth), wrong_ones + len(added - truth), missed + len(truth - added)
    assert right > 400 and wrong_ones <= 0.02 * right and missed <= 0.1 * right


def test_pii_adds_a_phone_number_that_a_pattern_swallows(spark, field):
    """A number followed by an address: the phone pattern runs on and drops both."""
    text = "Des +1 (826) 555-4081 190.137.223.204 du"
    assert [k for k, *_ in pii.base_spans(text)] == [1]
    got = pii.summary(pii.detect(frame(spark, [(1, text, None, None)]), field)).first()
    assert got["spans"] == "ip:22:37,phone:4:21" and (got["n_ip"], got["n_phone"]) == (1, 0)


def test_pii_beliefs_against_enumeration():
    """On graphs without cycles message passing is exact; with one it is near."""
    rng = np.random.default_rng(5)
    for edges, limit in (([(0, 1), (1, 2)], 1e-3), ([(0, 1), (1, 2), (0, 2)], 0.1)):
        f = pii.Field()
        f.unary, f.chain, f.skip = rng.normal(size=f.unary.shape) * 0.5, rng.normal(size=(5, 5)) * 0.5, rng.random(5)
        x = rng.random((3, pii.N_FEATURES))
        chain, skip = np.array(edges[:1]), np.array(edges[1:])
        want, u = np.zeros((3, 5)), x @ f.unary
        for y in np.ndindex(5, 5, 5):
            score = sum(u[i, y[i]] for i in range(3)) + f.chain[y[0], y[1]] + sum(f.skip[y[a]] for a, b in skip if y[a] == y[b])
            for i in range(3):
                want[i, y[i]] += np.exp(score)
        got = f.beliefs(x, chain, skip, np.zeros(3, int))
        assert np.abs(got - want / want.sum(1, keepdims=True)).max() < limit


def test_pii_long_texts_take_time_in_proportion(field):
    """Many base spans in one text, and a sample for training that reaches its end."""
    import time

    def seconds(n):
        text = " ".join(f"u{i}@mail.example.com x" for i in range(n))
        began = time.time()
        base, every = pii.find(field, [text])[0]
        assert len(base) == len(every) == n
        return time.time() - began

    seconds(500)
    assert seconds(16000) < 16 * max(seconds(2000), 0.05)
    words_ = pii.Words(" ".join(str(i) for i in range(5000)), [(1, 0, 1), (2, 23000, 23010)])
    part = words_.sampled(400)
    assert len(part.labels) <= 400 and (part.x[-1] == words_.x[-1]).all() and 0 < len(part.chain) < 400


def test_pii_ties_and_repeated_rows(spark):
    """A field that knows nothing adds nothing; equal rows get equal spans."""
    rows = [(1, "+1 (456) 555-2186 or 4111.1111.1111.1111", None, None)] * 3 + [(2, None, None, None)]
    blank = pii.Field()
    blank.unary[:] = 0
    got = [tuple(r) for r in pii.summary(pii.detect(frame(spark, rows), blank)).collect()]
    assert len(got) == 4 and len(set(got)) == 2 and all(r[-1] in ("", "phone:0:17") for r in got)


# ---- 2


def test_toxicity_folding_and_exceptions():
    assert toxicity.fold("An 1d10t, IDІOT!! $cum") == " an idiot idiot scum "
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " tra": 2.0, " trash ": 4.0}, exceptions=("trash can",))
    assert lexicon.read("trash idiot") == (7.0, 2)
    assert lexicon.read("a trash can") == (0.0, 3)
    assert lexicon.read("travel") == (2.0, 1)
    assert lexicon.read("") == (0.0, 0)


def test_toxicity_learns_from_labels(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = words(rng, 60) + (" grobian" * 3 if bad else "")
        rows.append((i, t, None, None))
        labels.append((i, int(bad) if i % 50 else None))
    rows += [(1000, None, None, None), (1001, "", None, None), (1002, "Gr0bian grоbian grobian", None, None)]
    df = clashing(frame(spark, rows))
    model = toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(400))
    assert got[1002]["predicted"] == 1 and got[1000]["score"] == got[1001]["score"] < 0.5
    assert {r["doc_id"] for r in toxicity.drop_toxic(df, model).select("doc_id").collect()} == {i for i in got if not got[i]["predicted"]}
    again = toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert np.array_equal(again.curve, model.curve) and again.lexicon.weights == model.lexicon.weights


def test_toxicity_without_labels(spark):
    df = frame(spark, [(1, "you idiot, you moron", None, None), (2, "fine words", None, None)])
    model = toxicity.learn(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["predicted"] for r in toxicity.score(df, model).orderBy("doc_id").collect()] == [1, 0]
    assert toxicity.score(empty(df), model).count() == 0


def test_toxicity_matching_against_a_naive_scan():
    rng = random.Random(8)
    vocabulary = ["idiot", "idiom", "trash", "trashy", "can", "fine", "tra", "scum", "is", "a"]
    weights = {" idiot ": 3.0, " tra": 2.0, " trash ": 4.0, " scu": 1.5, " scum ": 1.0, " idio": 2.5}
    exceptions = ("trash can", "a scum")
    lexicon = toxicity.Lexicon(weights, exceptions)
    for _ in range(300):
        text = rng.choice([" ", ", ", "!! "]).join(rng.choice(vocabulary).replace("i", rng.choice("i1İ")) for _ in range(rng.randrange(0, 12)))
        words_ = toxicity.fold(text).split()
        safe = {i + k for phrase in exceptions for i in range(len(words_)) for k in range(2) if words_[i : i + 2] == phrase.split()}
        total = 0.0
        for i, w in enumerate(words_):
            best = max((x for p, x in weights.items() if f" {w} ".startswith(p)), default=0.0)
            total += best * (i not in safe)
        assert lexicon.read(text) == (pytest.approx(total), len(words_)), text


def test_toxicity_folds_compatible_forms_and_accents():
    assert toxicity.fold("𝐢𝐝𝐢𝐨𝐭 ïdiot ⓘⓓⓘⓞⓣ ＩＤＩＯＴ іdіот") == " idiot idiot idiot idiot idiot "


def test_toxicity_learns_exceptions_and_stands_repeated_labels(spark):
    """A word that is toxic but in one phrase: the phrase is an exception. Repeated label rows change nothing."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        t = words(rng, 40) + (" grobian" if i % 3 == 0 else " grobian kiste" if i % 24 == 1 else "")
        rows.append((i, t, None, None))
        labels.append((i, int(i % 3 == 0)))
    df = frame(spark, rows)
    model = toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, model).collect()}
    assert np.mean([got[i] == int(i % 3 == 0) for i in range(300)]) > 0.97
    assert any("kiste" in e for e in model.lexicon.exceptions)
    twice = toxicity.learn(df, spark.createDataFrame(labels * 2, "doc_id long, toxic int"))
    again = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, twice).collect()}
    assert again == got


# ---- 3

ALPHABETS = {"aa": ["ba", "ko", "lu", "mi"], "bb": ["çé", "ñö", "tü", "ra"], "cc": ["xth", "wq", "zr", "kk"]}


def test_language(spark):
    rng = random.Random(2)
    make = lambda lang, n: " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, make(lang, rng.randrange(5, 150)), lang, None) for i, lang in enumerate(rng.choices(list(ALPHABETS), k=300))]
    rows += [(900, None, "aa", None), (901, "12 34 !?", "aa", None), (902, "", "aa", None), (903, make("bb", 30000), "bb", None), (904, make("cc", 40), None, None)]
    df = clashing(frame(spark, rows))
    net = langid.learn(df.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)))
    got = {r["doc_id"]: r for r in langid.identify(df, net).collect()}
    held = [(i, lang) for i, t, lang, _ in rows if i < 900 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 30 and np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.95
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "bb", "cc"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.learn(empty(df))
    assert {r["lang_pred"] for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(empty(df), net).count() == 0


def test_language_convolution_against_a_plain_one():
    net = langid.Network(["x", "y", "z"], seed=5)
    data = np.frombuffer("Ein Satz, né à Köln 12 — und 汉字!".encode() * 20, np.uint8)
    x, _ = langid.windows(data, np.array([0, len(data)]))
    got = net.probabilities(x)
    for row, p in zip(x, got, strict=True):
        tops = []
        for w, f in zip(langid.WIDTHS, net.filters, strict=True):
            values = [sum(net.embed[row[i + j]] @ f[j] for j in range(w)) for i in range(langid.WINDOW - w + 1)]
            tops.append(np.max(values, axis=0))
        hidden = np.maximum(np.concatenate(tops) + net.bias, 0)
        z = np.exp(hidden @ net.out + net.out_bias)
        assert np.allclose(p, z / z.sum(), atol=1e-5)


def test_language_ties_repeated_rows_and_many_languages(spark):
    """Equal probabilities give the first language; equal rows equal results; no language is left out for being one of many."""
    net = langid.Network(["b", "a"][::-1])
    net.out[:] = 0
    assert net.predict(pa.array(["word", "word", None]))[0] == ["a", "a", "und"]
    rows = [(i, f"{chr(0x4E00 + i % 260) * 40}", f"l{i % 260:03d}", None) for i in range(520)]
    assert len(langid.learn(frame(spark, rows)).languages) == 260


# ---- 4


def edit_distance_to_part(item, doc):
    row = [0] * (len(doc) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(doc, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(4)
    items = [words(rng, n, 3000).split() for n in (5, 8, 13, 21, 34, 55, 34)]
    items[6] = items[4]
    cut = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    rows, sure = [], []
    for i in range(80):
        doc = words(rng, rng.randrange(0, 80), 3000).split()
        if i % 2:
            n = rng.randrange(len(items))
            part = list(items[n])
            for _ in range(rng.randrange(0, decontam.edits(len(part)) + 1)):
                at = rng.randrange(len(part))
                part[at : at + rng.randrange(2)] = ["new"] * rng.randrange(2)
            at = rng.randrange(len(doc) + 1)
            doc[at:at] = part
        rows.append((i, " | ".join(doc).title() + ".", None, None))
    rows += [(900, None, None, None), (901, "", None, None), (902, " ".join(items[2]) + " " + words(rng, 20000) + " " + " ".join(items[5]), None, None)]
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)] + [(50, "too short"), (51, None), (52, "")], "item_id long, text string")
    df = clashing(frame(spark, rows))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.contaminated(df, bench).collect()}
    want = {}
    for i, t, *_ in rows[:-1]:
        for n, item in enumerate(items):
            d = edit_distance_to_part(item, cut(t))
            if d <= decontam.edits(len(item)):
                want[i, n] = d
    want[902, 2] = want[902, 5] = 0
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.95 * len(want) and all(k in got for k, d in want.items() if d == 0)
    clean = {r["doc_id"] for r in decontam.decontaminate(df, bench).select("doc_id").collect()}
    assert clean == {i for i, *_ in rows} - {i for i, _ in got}
    assert decontam.contaminated(df, bench.limit(0)).count() == 0 and decontam.contaminated(empty(df), bench).count() == 0


def found_in(items, texts):
    """{(text, item): distance} by the kernels alone."""
    block = decontam.Items(list(range(len(items))), [" ".join(w) for w in items])
    return {(row, item): d for row, item, d, _ in decontam._scan(block)(pa.array([" ".join(t) for t in texts]))}


def test_decontamination_contiguous_edits():
    """All edits in one place, as many as allowed: a passage lost, or rewritten, at the start, the middle or the end."""
    rng = random.Random(7)
    items = [words(rng, rng.randrange(5, 64), 10**6).split() for _ in range(120)]
    texts = []
    for w in items:
        k = decontam.edits(len(w))
        for at in (0, (len(w) - k) // 2, len(w) - k):
            for new in ([], ["rewritten"] * k):
                texts.append(words(rng, 20).split() + w[:at] + new + w[at + k :] + words(rng, 20).split())
    got = found_in(items, texts)
    assert set(got) == {(i, i // 6) for i in range(len(texts))}
    assert all(got[i, n] == edit_distance_to_part(items[n], texts[i]) for i, n in list(got)[::7])


@pytest.mark.parametrize("length", [200, 600, 2000])
def test_decontamination_long_items(length):
    """As many edits as allowed, spread over the item: words changed, lost and added."""
    rng = random.Random(length)
    items = [words(rng, length, 10**6).split() for _ in range(20)]
    texts = []
    for w in items:
        copy = list(w)
        for at in sorted(rng.sample(range(length), decontam.edits(length)), reverse=True):
            kind = rng.randrange(3)
            copy[at : at + (kind != 0)] = ["new"] * (kind != 1)
        texts.append(words(rng, 30).split() + copy + words(rng, 30).split())
    assert set(found_in(items, texts)) == {(n, n) for n in range(20)}


def test_decontamination_short_unspaced_and_unnamed_items(spark):
    thai, han = "ประเทศไทยมีเมืองหลวงชื่อว่ากรุงเทพมหานคร", "中国的首都是哪个城市？请回答。"
    items = [(1, "What is 2 + 2?"), (2, han), (3, thai), (None, "one item that has no number at all"), (5, "日本"), (6, "?!"), (7, "𠀀𠀁𠀂")]
    docs = [
        (0, "So: what IS 2+2 then", None, None),
        (1, "what is 2 and 2", None, None),
        (2, "前言" + han.replace("哪", "那") + "后记", None, None),
        (3, "see " + thai + "ครับ", None, None),
        (4, "here is one item that has no number at all.", None, None),
        (5, "東京は日本の首都です", None, None),
        (6, "日、本", None, None),
        (7, "日 x 本 ?!", None, None),
        (8, "a𠀀𠀁𠀂b 首都", None, None),
        (9, "中国的城市", None, None),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"], r["item_words"]) for r in decontam.contaminated(frame(spark, docs), bench).collect()}
    # Blanks and the signs of a script part words but are none: "日、本" is the item word by word.
    assert got == {(0, 1, 0, 4), (2, 2, 1, 13), (3, 3, 0, len(thai)), (4, None, 0, 8), (5, 5, 0, 2), (6, 5, 0, 2), (8, 7, 0, 3)}
    assert {r["doc_id"] for r in decontam.decontaminate(frame(spark, docs), bench).collect()} == {1, 7, 9}


def test_alignment():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(lo, 30))] for lo in (1, 0))
        assert decontam.alignment(a, b)[0] == edit_distance_to_part(a, b)


# ---- 5


def brute_repeats(blobs, length):
    seen = {}
    for b in blobs:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in blobs:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_suffix_dedup(docs, batches):
    df, rows = docs
    small = [r for r in rows if len(r[1] or "") < 20000]
    part = df.where("text is null or length(text) < 20000")
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixdedup.remove_repeats(part, batches=batches).collect())
    want = brute_repeats([(r[1] or "").encode() for r in small], suffixdedup.LENGTH)
    assert got == sorted((r[0] is None, r[0], *w) for r, w in zip(small, want, strict=True))
    assert sum(w[1] for w in want) > 0


def test_suffix_dedup_over_segments(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "SEGMENT_BITS", 12)
    rng = random.Random(8)
    a = words(rng, 4000, 10**6)
    blobs = [a, words(rng, 50) + a[3000:9000] + words(rng, 50), "x" * 9000]
    data, at = np.frombuffer("".join(blobs).encode(), np.uint8), np.cumsum([0] + [len(b) for b in blobs])
    row, place, *_ = suffixdedup.suffixes(data, at)
    windows = sum(place >> 9 & 511)
    assert windows == sum(max(0, len(b) - suffixdedup.LENGTH + 1) for b in blobs)
    covered = {(int(r), int((p >> 18) + k)) for r, p in zip(row, place, strict=True) for k in range(int(p >> 9 & 511))}
    assert len(covered) == windows


def digests(df):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def test_suffix_index_is_kept_opened_and_added_to(spark, tmp_path):
    """Three batches one at a time, the index closed in between: as the brute force over all."""
    rng = random.Random(21)
    passage, other = words(rng, 90, 10**6), words(rng, 100, 10**6)
    rows = [(i, words(rng, rng.randrange(5, 300), 10**6), None, None) for i in range(45)]
    for i in range(0, 45, 7):
        rows[i] = (i, f"{rows[i][1]} {passage} {words(rng, 30)}", None, None)
    rows[44] = (44, other + rows[3][1] + other, None, None)
    root = f"file://{tmp_path}/index"
    for n, part in enumerate((rows[:20], rows[20:25], rows[25:])):
        index = suffixdedup.LevelIndex(spark, root) if not n else suffixdedup.LevelIndex.open(spark, root)
        index.add_documents(suffixdedup.keyed_texts(frame(spark, part)))
    assert sorted(index.levels) == [0, 1] and len(index.marks) == 3
    level = spark.read.parquet(index.levels[1])
    part = level.select("head", "next", F.input_file_name().alias("p")).collect()
    for p in {r["p"] for r in part}:
        order = [(r["head"], r["next"]) for r in part if r["p"] == p]
        assert order == sorted(order)
    got = suffixdedup.remove_repeats(frame(spark, rows), index=suffixdedup.LevelIndex.open(spark, root))
    want = brute_repeats([r[1].encode() for r in rows], suffixdedup.LENGTH)
    assert digests(got) == sorted((r[0], *w) for r, w in zip(rows, want, strict=True))
    assert sum(w[1] > 0 for w in want) > 8


def test_suffix_heads_are_in_alphabetical_order():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    place = np.arange(0, 3900, 3)
    a, b = suffixdedup.heads(data, place)
    order = np.lexsort((b, a))
    assert [bytes(data[p : p + 16]) for p in place[order]] == sorted(bytes(data[p : p + 16]) for p in place)


def test_suffix_dedup_reports_passages_too_short_to_go(spark):
    """Passages of 51 to 58 words, under 400 bytes: reported and not removed; documents without any have none."""
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(60):
        passage = text(rng.randrange(51, 59))
        assert len(passage) < suffixdedup.LENGTH
        rows += [(10 * i + k, f"{text(120)} {passage} {text(120)}", None, None) for k in range(4)]
    rows += [(10 * i + 9, text(300), None, None) for i in range(60)]
    got = {r["doc_id"]: r for r in suffixdedup.remove_repeats(frame(spark, rows)).collect()}
    assert all(r["n_removed"] == 0 for r in got.values())
    assert np.mean([got[i]["n_passages"] > 0 for i in got if i % 10 != 9]) > 0.9
    assert all(got[i]["n_passages"] == 0 for i in got if i % 10 == 9)


def test_suffix_dedup_empty(docs):
    assert suffixdedup.remove_repeats(empty(docs[0])).count() == 0


# ---- 6


def filled(sizes, weights, cap):
    left, out = dict(sizes), {}
    total = sum(sizes.values())
    while left:
        w = sum(weights[s] for s in left)
        over = [s for s in left if total * weights[s] / w > cap * sizes[s] * (1 + 1e-12)]
        if not over:
            return out | {s: total * weights[s] / w for s in left}
        for s in over:
            out[s] = cap * left.pop(s)
            total -= out[s]
    return out


def test_mixing(docs):
    df, rows = docs
    got = mixing.mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in got) == sorted(size(r[1]) for r in rows)
    names = sorted({r[3] for r in rows if r[3]}) + [None]
    sizes = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in names}
    want = filled({s: n for s, n in sizes.items()}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 3)
    for s in names:
        own = [r for r in got if r["source"] == s]
        assert own[0]["source_size"] == sizes[s] and own[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(20, 0.01 * want[s])
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    again = sorted(map(str, mixing.mix(df).collect()))
    assert again == sorted(map(str, got))
    assert mixing.mix(empty(df)).count() == 0


def test_mixing_caps_small_sources(spark):
    rows = [(i, words(random.Random(i), 400), None, "big") for i in range(20)] + [(90, "one two three", None, "a"), (91, "one", None, "z")]
    got = mixing.mix(frame(spark, rows)).collect()
    taken = {s: sum(r["taken"] for r in got if r["source"] == s) for s in ("a", "z")}
    assert taken == {"a": 9, "z": 3}


def test_mixing_small_sources_where_blocks_are_large(spark):
    """Each source's words come near its own target, also those of less than a block."""
    rng = random.Random(11)
    sizes = {"a": 150000, "b": 9, "c": 70000, "d": 40, "e": 200, "f": 3000, None: 25}
    rows = []
    for s, left in sizes.items():
        while left:
            n = min(left, rng.randrange(1, 300))
            rows.append((len(rows), words(rng, n), None, s))
            left -= n
    rows.append((len(rows), "", None, "without words"))
    df = frame(spark, rows)
    got = mixing.mix(df, n_slots=1 << 12).collect()
    assert -(-sum(sizes.values()) // (1 << 12)) > 50
    for s, size in sizes.items():
        own = [r for r in got if r["source"] == s]
        assert own[0]["source_size"] == size
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1 + 0.01 * own[0]["target"]
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    tiny = [r for r in got if r["target"] == 3 * r["source_size"] > 0]
    assert {r["source"] for r in tiny} >= {"b", "d", None} and all(r["copies"] == 3 for r in tiny)
    out = {r["source"]: r["count"] for r in mixing.apply(df, n_slots=1 << 12).groupBy("source").count().collect()}
    assert out["b"] == 3 * sum(r[3] == "b" for r in rows)


def test_mixing_whole_documents(docs):
    df, rows = docs
    out = mixing.apply(df)
    assert out.columns == df.columns
    assert max(r["count"] for r in out.groupBy("doc_id", "text").count().where("doc_id is not null and doc_id <> 5").collect()) <= 3


# ---- 7


def test_sharding(docs):
    df, rows = docs
    owner = sharding.lookup_table(sharding.shard_names(64), sharding.TABLE_SIZE)
    got = sharding.place(df).collect()
    assert len(got) == len(rows)
    for r in got:
        slot = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert (r["slot"], r["shard"]) == (slot, owner[slot])
    assert sharding.place(empty(df)).count() == 0


def test_lookup_table_against_a_plain_filling():
    """Whole orders of preference, and turns taken over them."""
    names, size = sharding.shard_names(7), 101
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    orders = [[(number(f"{s}/offset") + j * (number(f"{s}/skip") % (size - 1) + 1)) % size for j in range(size)] for s in names]
    assert all(sorted(o) == list(range(size)) for o in orders)
    owner: dict[int, int] = {}
    while len(owner) < size:
        for i, order in enumerate(orders):
            slot = next((s for s in order if s not in owner), None)
            if slot is not None:
                owner[slot] = i
    assert sharding.lookup_table(names, size) == [owner[s] for s in range(size)]


def test_sharding_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", "b", "c")], "doc_id long, slot string, shard string, slot_input string")
    got = sharding.place(df).first()
    assert (got["slot_input_input"] if "slot_input_input" in got else got["slot_input"]) is not None
    assert {"a", "b", "c"} <= set(got) and isinstance(got["slot"], int)


def test_lookup_table_is_even_and_stable():
    names = sharding.shard_names(20)
    a = sharding.lookup_table(names, 2003)
    assert sorted(np.bincount(a))[0] >= 2003 // 20 and max(np.bincount(a)) <= 2003 // 20 + 1
    b = [names[:7] + names[8:]][0]
    after = [b[i] for i in sharding.lookup_table(b, 2003)]
    moved = sum(names[x] != y for x, y in zip(a, after, strict=True) if names[x] != names[7])
    assert moved < 0.25 * 2003
    for bad in ((names, 2004), ([], 2003), (["a", "a"], 2003)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


# ---- 8


def test_licenses(spark):
    rows = [
        ("r/LICENSE", "Released under the MIT License."), ("r/a/x.py", "code\ncode"), ("r/a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("r/a/b/y.py", "more"),
        ("r/a/z.py", "code code code code code code code code code code code\nLicensed under CC BY-NC 4.0.\ncode"), ("q/x.py", "licensed premises sell drinks here on most days of the year"), ("r/e.py", ""), ("r/n.py", None), (None, "x"), ("r/LICENSE", "Released under the MIT License."),
    ]
    df = clashing(spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string"))
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert [got[i]["license"] for i in range(10)] == ["MIT", "Apache-2.0", "Apache-2.0", "Apache-2.0", "CC-BY-NC-4.0", None, "MIT", "MIT", None, "MIT"]
    assert got[3]["inherited_from"] == "r/a/LICENSE" and got[4]["own_license"] == "CC-BY-NC-4.0" and not got[4]["is_license_file"] and got[0]["is_license_file"]
    assert licenses.scan(df.limit(0)).count() == 0


def brute_licenses(texts):
    """(license, score) of each text by comparing every unit with every template."""
    n = len(texts) + len(licenses.TEMPLATES)
    docs = [set(licenses.words_of(t or "")) for t in [*texts, *[t for _, t in licenses.TEMPLATES]]]
    idf = lambda w: np.log((1 + n) / (1 + sum(w in d for d in docs))) + 1
    known = {w: idf(w) for w in licenses.vocabulary()}
    vec = lambda t: {w: k * known.get(w, np.log(1 + n) + 1) for w, k in Counter(licenses.words_of(t)).items()}
    norm = lambda v: sum(x * x for x in v.values()) ** 0.5
    templates = [(name, vec(t)) for name, t in licenses.TEMPLATES]
    out = []
    for t in texts:
        blocks = re.split(licenses.BLANK_LINES, t or "")
        units = [t or ""] * (len(blocks) > 1) + [u for b in blocks for u in ([b] * (b.strip("\n").count("\n") > 0) + b.split("\n"))]
        best = (None, 0.0)
        for u in units:
            v = vec(u)
            for name, x in templates:
                if len(v.keys() & x.keys()) >= 2:
                    c = round(sum(v[w] * x.get(w, 0) for w in v) / norm(v) / norm(x), 9)
                    if c >= licenses.MIN_COSINE and c > best[1]:
                        best = (name, c)
        out.append(best)
    return out


def wrapped(text, width=60, mark="# "):
    import textwrap

    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_licenses_of_headers_texts_and_notices(spark):
    """Notices in either spelling, wrapped headers and texts, against a comparison of all units with all templates."""
    t = dict(zip([f"{n}{i}" for i, (n, _) in enumerate(licenses.TEMPLATES)], [x for _, x in licenses.TEMPLATES], strict=True))
    mit = "MIT License\n\nCopyright (c) 2020 A Name\n\n" + "\n\n".join(wrapped(x, 70, "") for x in (t["MIT3"], t["MIT4"], t["MIT5"])) + "\n"
    texts = [
        (wrapped(t["MIT3"]) + "\n\nimport x\n" + "y = x + 1\n" * 40, "MIT"), (wrapped(t["GPL-3.016"], 50, " * ") + "\n\n" + "int main() { return 0; }\n" * 30, "GPL-3.0"),
        ("Released under the MIT Licence.", "MIT"), ("This work is in CC BY 4.0", "CC-BY-4.0"), ("SPDX: Apache-2.0", "Apache-2.0"), (mit, "MIT"),
        (wrapped(t["Apache-2.010"]) + "\n#\n" + wrapped(t["Apache-2.011"]) + "\n\ncode\n", "Apache-2.0"), (wrapped(t["BSD-3-Clause35"], 76, ""), "BSD-3-Clause"),
        ("Mit dem Zug fahren wir nach Hause.\nmit\nlicense", None), ("the software is good and the license fee is high\n\nversion 2 of the terms was published", None),
        ("You may sell copies of this book, subject to no conditions whatever.", None), ("", None), (None, None), ("x " * 30000 + "\nMIT License\n", "MIT"),
    ]
    df = clashing(spark.createDataFrame([(i, f"d{i}/f", x) for i, (x, _) in enumerate(texts)], "doc_id long, path string, text string"))
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert [got[i]["own_license"] for i in range(len(texts))] == [w for _, w in texts]
    for i, (name, score) in enumerate(brute_licenses([x for x, _ in texts])):
        assert got[i]["own_license"] == name and (got[i]["score"] or 0.0) == pytest.approx(score, abs=1e-8)
    assert got[5]["is_license_file"] and got[7]["is_license_file"] and not got[0]["is_license_file"] and not got[13]["is_license_file"]


# ---- 9


def test_embeddings(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 24))
    rows = []
    for i in range(300):
        v = base[i % 40] + rng.normal(size=24) * rng.choice([0.0, 0.02, 0.2, 0.3])
        rows.append((i, v.tolist(), int(i % 3)))
    rows += [(400, None, 1), (401, [0.0] * 24, 1), (402, [float("nan")] * 24, 1), (403, [1.0, None] + [0.0] * 22, 1), (404, base[0].tolist(), None), (405, [float("inf")] * 24, 1), (406, [], 1), (407, [1.0, 2.0], 1), (408, [2.0, 4.0], 1), (None, base[1].tolist(), 1), (5, rows[5][1], 2), (409, (base[0] * 1e3).tolist(), 0)]
    # Links hold at any scale, and none appears where squares would be 0 or infinite.
    tiny, turned = np.array([1.0, 2.0, 3.0]), np.array([1.0, 2.0, 1.9])
    for i, scale in enumerate((1e-200, 1e200, 1e-320, 1.7e308 / 3)):
        rows += [(500 + 4 * i, (tiny * scale).tolist(), 7 + i), (501 + 4 * i, (tiny * 1.5 * scale if scale < 1e300 else tiny * scale / 2).tolist(), 7 + i), (502 + 4 * i, (turned * scale).tolist(), 7 + i)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = embed_dedup.near_duplicates(df).collect()

    def sound(r):
        return r[0] is not None and r[1] is not None and r[2] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    def cos(a, b):
        a, b = (np.array(v) / np.abs(v).max() for v in (a, b))
        return a @ b / (a @ a) ** 0.5 / (b @ b) ** 0.5

    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if sound(rows[i]) and sound(rows[j]) and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                link[i, j] = link[j, i] = cos(rows[i][1], rows[j][1]) >= 0.98
    want = []
    for i in range(n):
        reach, front = {i}, [i]
        while front:
            new = [int(k) for j in front for k in np.flatnonzero(link[j]) if int(k) not in reach]
            reach.update(new)
            front = new
        c = min(rows[k][0] for k in reach) if rows[i][0] is not None else None
        want.append((str(rows[i][0]), int(link[i].sum()), str(c), c == rows[i][0]))
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == sorted(want)
    assert link.sum() > 100
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


# ---- 10


def brute_components(rows, k, percent):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
        return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])

    sets = [shingles(r[1]) for r in rows]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return [(str(r[0]), len(s), str(None if r[0] is None else find(r[0])), r[0] is None or find(r[0]) == r[0]) for r, s in zip(rows, sets, strict=True)]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_minhash(docs, k, percent):
    df, rows = docs
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(df, k, percent).collect())
    assert got == sorted(brute_components(rows, k, percent))


def test_minhash_group_of_near_copies(spark):
    """A group in which few pairs reach the threshold: components are those of all pairs."""
    rng = random.Random(10)
    base = words(rng, 150, 10**6).split()
    rows = []
    for i in range(80):
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy), None, None))
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(frame(spark, rows), 3, 85).collect())
    assert got == sorted(brute_components(rows, 3, 85))


def test_minhash_deduplicate(docs):
    df, rows = docs
    out = minhash.deduplicate(df)
    assert out.columns == df.columns
    want = {i for i, n, c, kept in brute_components(rows, 5, 80) if kept}
    assert sorted(str(r["doc_id"]) for r in out.where("doc_id is not null").collect()) == sorted(want - {"None"})
    assert minhash.near_duplicates(empty(df), 3, 85).count() == 0


def test_odd_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(11)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 5, 500, 5000)]
    sets += [np.unique(np.concatenate([s[: len(s) - len(s) // 9], rng.integers(0, 2**63, 3).astype(np.uint64)])) for s in sets]
    odd = minhash.odd_sketches(np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets]))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            differ = len(np.setxor1d(a, b))
            assert sum(int(x).bit_count() for x in (odd[i] ^ odd[j]).tolist()) <= differ


# ---- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    item = words(rng, 30, 5000)
    rows = [(i, words(rng, 120, 5000), "en", f"s{i % 2}") for i in range(120)]
    rows += [(200, rows[3][1] + " tail", "en", "s0"), (201, words(rng, 20, 5000) + " " + item + " " + words(rng, 20, 5000), "en", "s1"), (202, "idiot moron scum " * 4, "en", "s1"), (203, None, None, None)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot", "shard"]
    ids = {r["doc_id"] for r in out.collect()}
    assert not ids & {200, 201, 202} and ids <= {r[0] for r in rows}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert {r["doc_id"] for r in docs.collect()} == set(range(120)) | {203}


def test_pipeline_with_nulls_repeats_and_other_columns(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, ties, clashing columns; and empty tables."""
    import corpus_pipeline

    rng = random.Random(13)
    rows = [(i, words(rng, 80, 5000), "en", f"s{i % 3}" if i % 5 else None) for i in range(60)]
    rows += [rows[4], rows[4], (None, rows[7][1], None, None), (None, None, None, None), (70, "", "en", "s0"), (71, None, None, "s1"), (72, rows[9][1], "en", "s2"), (73, "idiot moron scum " * 5, None, None)]
    docs = clashing(frame(spark, rows))
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(None, "too short"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, path)
        assert kept.columns == docs.columns, name
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    # The toxic row, the repeated rows and the copy of greater id are gone; rows without an id or words stay.
    assert ids == sorted([i for i in range(60)] + [None, None, 70, 71], key=str)
    out = corpus_pipeline.run(spark, path)
    assert set(docs.columns) <= set(out.columns) and {r["doc_id"] for r in out.collect()} <= set(ids)
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{path}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{path}/empty").count() == 0
