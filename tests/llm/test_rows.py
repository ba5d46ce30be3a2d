"""Surrogates, host reputation, toxicity and chat formatting."""

import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from newsburst.llm import chat, queries, reputation, surrogates, toxicity

DOCS = "doc_id long, text string"


def test_surrogates(spark):
    mail, phone, card, ip = "ann.lee@mail7.example.com", "+1 (017) 555-7713", "4550 9978 1072 0808", "97.51.17.173"
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [
        (1, f"Write to {mail}, or {mail.upper()}. Call {phone}!"),
        (2, f"{phone} {card} 4550997810720808 {ip}. {secret}"),
        (3, f"Herr Müller met Frau Ana Ruiz; Frau Müller left. Г-н Иванов. Mrs. Smith {mail}"),
        (4, None), (5, ""), (6, "Plain text, 12 of 34."), (6, "Plain text, 12 of 34."), (None, f"x {ip}"),
        (7, "word " * 20_000 + mail),
    ]
    docs = spark.createDataFrame([(*r, 0, "k") for r in rows], DOCS + ", n_entities int, _entities string")
    result, count = surrogates.with_surrogates(docs, "secret key")
    got = {(r.doc_id, r.text is None): r for r in result.collect()}
    assert result.columns[:4] == docs.columns and count not in docs.columns and result.count() == len(rows)
    texts = {d: r.text for (d, _), r in got.items()}
    joined = " ".join(t for t in texts.values() if t)
    for entity in (mail, phone, card, "4550997810720808", ip, secret, "Müller", "Ana Ruiz", "Иванов", "Smith"):
        assert entity.lower() not in joined.lower()
    new_mail = re.search(r"to (\S+@\S+\.com),", texts[1])[1]
    assert new_mail in texts[3] and new_mail in texts[7] and joined.lower().count(new_mail) == 4
    new_phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", texts[1])[0]
    assert texts[2].startswith(new_phone)
    spaced, plain = re.search(r"(\d{4} \d{4} \d{4} \d{4}) (\d{16})", texts[2]).groups()
    assert spaced.replace(" ", "") == plain
    assert re.search(r"(\d{1,3}\.){3}\d{1,3}", texts[None])[0] in texts[2]
    assert re.search(r"\b[0-9a-f]{40}$", texts[2])
    men, woman, other = re.search(r"Herr (\w+) met Frau (\w+ \w+); Frau (\w+) left", texts[3]).groups()
    assert men.endswith("rd") and other.endswith("ra") and all(w.endswith("ra") for w in woman.split())
    assert re.search(r"Г-н [А-Яа-я]+ов\.", texts[3])
    assert texts[4] is None and texts[5] == "" and texts[6] == rows[5][1]
    again = surrogates.pseudonymize(docs.select("doc_id", "text"), "secret key")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, result.select("doc_id", "text").collect()))
    other_key = surrogates.pseudonymize(docs.select("doc_id", "text"), "another").filter("doc_id = 1").first().text
    assert new_mail not in other_key
    assert surrogates.pseudonymize(spark.createDataFrame([], DOCS), "k").count() == 0


def test_surrogates_of_more_forms(spark):
    forms = [
        "06 12 34 56 78", "030 12345678", "0171/1234567", "+33 1 23 45 67 89", "+34 612 34 56 78", "212 555 0199",
        "GB82 WEST 1234 5698 7654 32", "NL91ABNA0417164300", "FR14 2004 1010 0505 0001 3M02 606",
        "2001:db8:85a3:0:0:8a2e:370:7334", "2001:db8::ff00:42:8329",
    ]
    rows = [(i, f"see {f}, then") for i, f in enumerate(forms)]
    rows += [(50, "Herr Mueller kam. Mueller sagte, Muellerin nicht."), (51, "+1 212-555-0199 or 212-555-0199.")]
    rows += [(52, "At 12:30:45 std::vector 1 234 567 and 2024-05-01 10:20.")]
    rows += [(53, "code DE12 ABCD EFGH IJKL, 123456 end"), (54, "code DE12 ABCD EFGH IJKL 123456 end")]
    got = {r.doc_id: r.text for r in surrogates.pseudonymize(spark.createDataFrame(rows, DOCS), "k").collect()}
    for i, f in enumerate(forms):
        new = re.fullmatch("see (.*), then", got[i])[1]
        assert new != f and re.sub("[0-9A-Za-z]", "x", new) == re.sub("[0-9A-Za-z]", "x", f)
        assert f[-5:] not in new
    first, again = re.fullmatch(r"Herr (\w+) kam\. (\w+) sagte, Muellerin nicht\.", got[50]).groups()
    assert first == again != "Mueller"
    a, b = re.fullmatch(r"\+1 (\S+) or (\S+)\.", got[51]).groups()
    assert a == b != "212-555-0199"
    assert got[52] == rows[-3][1] and got[53] == rows[-2][1]
    assert len(got[54]) == len(rows[-1][1]) and got[54].endswith(" end")


def test_surrogates_of_names(spark):
    """Clean words stay, and one person has one name."""
    texts = [
        "Frau Schmidt Gestern war es kalt. Gestern war Montag.",
        "Der Herr Minister sprach. Alle Minister hörten Herr Minister Kohl. Kohl ging.",
        "Mr May arrived in May 2024. Mr Dan May 3 times.",
        "Mr John Smith came. Mr Smith left, Smith's coat and John stayed. Mr. John went.",
        "Mr Brown wore a brown hat. Brown hats suit Brown.",
        "dass Frau Vogel Angst hat, denn die Angst bleibt. Angst und Vogel.",
        "Mrs Smith and Mr O’Neil met. O’Neil left.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: r.text for r in surrogates.pseudonymize(docs, "k").collect()}
    assert re.fullmatch(r"Frau \w+ra Gestern war es kalt\. Gestern war Montag\.", got[0])
    assert re.fullmatch(r"Der Herr Minister sprach\. Alle Minister hörten Herr Minister (\w+rd)\. \1 ging\.", got[1])
    assert re.fullmatch(r"Mr (\w+rd) arrived in May 2024\. Mr \w+rd May 3 times\.", got[2])
    john, smith = re.fullmatch(
        r"Mr (\w+rd) (\w+rd) came\. Mr \2 left, \2's coat and \1 stayed\. Mr\. \1 went\.", got[3]
    ).groups()
    assert len({john, smith, "John", "Smith"}) == 4
    assert re.fullmatch(r"Mr (\w+rd) wore a brown hat\. Brown hats suit \1\.", got[4])
    assert re.fullmatch(r"dass Frau (\w+ra) Angst hat, denn die Angst bleibt\. Angst und \1\.", got[5])
    assert re.fullmatch(r"Mrs (\w+ra) and Mr (\w+rd) met\. \2 left\.", got[6])


def _luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])


def test_surrogates_keep_check_digits(spark):
    cards = ["4111 1111 1111 1111", "378282246310005", "3782 822463 10005", "6011000990139424", "4222222222222"]
    ibans = ["GB82 WEST 1234 5698 7654 32", "NL91ABNA0417164300", "DE89370400440532013000", "FR14 2004 1010 0505 0001 3M02 606"]
    docs = spark.createDataFrame([(i, f"pay {n} now") for i, n in enumerate(cards + ibans)], DOCS)
    for r in surrogates.pseudonymize(docs, "k").collect():
        old, new = (cards + ibans)[r.doc_id], re.fullmatch("pay (.*) now", r.text)[1]
        plain = new.replace(" ", "")
        assert new != old and re.sub("[0-9A-Z]", "x", new) == re.sub("[0-9A-Z]", "x", old)
        if r.doc_id < len(cards):
            assert _luhn(plain) % 10 == 0
        else:
            assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_surrogates_of_a_table(spark):
    """Each text of the test table with the surrogates taken back is what it was, and one entity has one surrogate."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pairs = [(r.text, r.new, r.n) for r in docs.select("doc_id", "text").dropDuplicates(["doc_id"]).join(
        surrogates.with_surrogates(docs.dropDuplicates(["doc_id"]).select("doc_id", "text"), "k")[0]
        .select("doc_id", F.col("text").alias("new"), F.col("n_entities").alias("n")), "doc_id").collect()]
    assert len(pairs) == docs.select("doc_id").distinct().count()
    pattern = regex.compile(surrogates.PATTERN.replace(r"\p{IsCyrillic}", r"\p{Cyrillic}"))
    forward, back = {}, {}
    for old, new, n in pairs:
        found = list(pattern.finditer(old or ""))
        assert n == len(found)
        if not found:
            assert old == new
            continue
        people = [m[0] for m in found if regex.match(surrogates._LEAD, m[0])]
        if people:  # their later mentions change too
            continue
        plain = [old[a:b] for a, b in zip([0, *(m.end() for m in found)], [*(m.start() for m in found), len(old)])]
        taken = regex.fullmatch("(.+?)".join(map(regex.escape, plain)), new, flags=regex.DOTALL)
        assert taken
        for m, surrogate in zip(found, taken.groups()):
            entity = regex.sub(r"[^0-9\p{L}]", "", m[0]).lower()
            surrogate = regex.sub(r"[^0-9\p{L}]", "", surrogate).lower()
            assert surrogate != entity
            assert forward.setdefault(entity, surrogate) == surrogate and back.setdefault(surrogate, entity) == entity


def test_surrogates_collide(spark):
    """More short addresses than the first shape has room for stay distinct."""
    forms = [f"{a}@x.com" for a in "abcdefghijklmnopqrstuvwxyz"] + [f"{a}{i}@x.com" for a in "abc" for i in range(10)]
    found = surrogates.assign(spark.createDataFrame([("email", f) for f in forms], "kind string, form string"), "k")
    rows = found.collect()
    assert sorted(r.form for r in rows) == sorted(forms)
    assert len({r.surrogate for r in rows}) == len(forms)
    assert not {r.surrogate for r in rows} & set(forms)


def test_reputation(spark):
    urls = [
        "http://a.spam.example.net/x", "https://A.Spam.example.NET/y?q#z", "http://good.example.net", None, "", "no scheme",
        "http://x.example.org/es/1", "http://example.org/es/1", "http://example.org/en/12", "http://example.org/fr",
        "http://www.shop.com/fr/a", "http://shop.com/de/a", "http://org/", "http://notexample.org?x://y/z", "a://É.com/",
        "http://b.co.uk/x/y",
    ]
    rows = [(i, u) for i, u in enumerate(urls)] + [(100 + i, "http://a.spam.example.net/") for i in range(60)] + [(0, urls[0])]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, host string")
    outcomes = [(100 + i, True) for i in range(60)] + [(2, False), (2, None), (7, False), (None, True)]
    bad = spark.createDataFrame(outcomes, "page_id long, bad boolean")
    got = {(r.page_id): r for r in reputation.filter_urls(pages, bad).collect()}
    assert reputation.filter_urls(pages, bad).count() == len(rows)
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.spam.example.net", "/y", None, "block")
    assert (got[3].host, got[3].path, got[4].host, got[5].host) == ("", "", "", "")
    assert (got[6].rule, got[7].rule, got[8].rule, got[9].rule) == ("example.org/es/", "example.org/es/", "example.org/en/1", "org/")
    assert (got[10].verdict, got[11].verdict, got[12].rule) == ("allow", "block", "org/")
    assert (got[13].host, got[13].path, got[13].rule) == ("notexample.org", "", None)
    assert got[14].host == "É.com" and got[2].verdict == "allow"
    known = {r.host: r for r in reputation.host_reputation(pages.select("page_id", reputation.host_and_path(F.col("url"))[0].alias("host")), bad).collect()}
    assert known["b.co.uk"].domain == "b.co.uk" and known["b.co.uk"].suffix == "co.uk"
    spam, good = known["a.spam.example.net"], known["good.example.net"]
    assert spam.n == 60 and good.n == 1 and spam.mean > good.mean > 0
    assert spam.low < spam.mean < spam.high
    none = spark.createDataFrame([], "page_id long, bad boolean")
    assert {r.verdict for r in reputation.filter_urls(pages, none).filter("rule is null").collect()} == {"allow"}
    assert reputation.filter_urls(pages.limit(0), bad).count() == 0


def test_chat_fold_and_render(spark):
    log = [
        ("c", 1, 0, "delta", "system", "be "), ("c", 1, 1, "delta", None, "kind"),
        ("c", 2, 0, "delta", "user", "old"), ("c", 2, 1, "edit", "user", "<|start|> a\\b \\l"),
        ("c", 3, 0, "delta", "assistant", "draft"), ("c", 3, 2, "delta", "assistant", "B\n<|end|>"),
        ("c", 3, 1, "regenerate", "assistant", None), ("c", 3, 3, "unknown", None, "x"), ("c", 3, 4, "delta", None, None),
        ("d", None, 0, "delta", None, None), (None, 1, 0, "delta", "a\nb<", "t"),
    ]
    events = spark.createDataFrame(log, "conv_id string, message_id long, seq int, kind string, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold(events))).collect()}
    assert [tuple(t) for t in back["c"].turns] == [
        ("system", "be kind"), ("user", "<|start|> a\\b \\l"), ("assistant", "B\n<|end|>"),
    ]
    assert back["c"].loss_text == "B\n<|end|>"
    assert [tuple(t) for t in back["d"].turns] == [("", "")] and back["d"].loss_text == ""
    assert [tuple(t) for t in back[None].turns] == [("a\nb<", "t")]


def test_chat_escapes_every_text(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("\\<ln|end>\n é") for _ in range(rng.randrange(12))) for _ in range(200)] + ["x" * 50_000]
    rows = [(i, 0, "assistant", t, "extra") for i, t in enumerate(texts)] + [(0, 0, "assistant", texts[0], "extra")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message_id string")
    formatted = chat.render(chat.fold(chat.as_events(turns)))
    for r in chat.read_back(formatted).collect():
        copies = 2 if r.conv_id == 0 else 1
        assert [tuple(t) for t in r.turns] == [("assistant", texts[r.conv_id])] * copies
        assert r.loss_text == texts[r.conv_id] * copies
    assert chat.render(chat.fold(chat.as_events(turns.limit(0)))).count() == 0


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(11)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for d in range(600):
        toxic, mean = d % 4 == 0, d % 8 == 0
        text = [rng.choice(plain) for _ in range(rng.randrange(20, 60))]
        if toxic:
            text += rng.sample(["vile", "nasty", "awful"], 2)
        if mean:
            text += ["brute" + rng.choice("abcdefgh") * 3]
        rng.shuffle(text)
        rows.append((d, " ".join(text)))
        labels.append((d, int(mean), int(toxic)))
    return rows, labels


def test_toxicity_chain(spark, labelled):
    rows, labels = labelled
    docs = spark.createDataFrame([*rows, (600, None), (601, ""), (602, "vile " * 30_000)], DOCS)
    marks = spark.createDataFrame([x for x in labels if x[0] < 400] + [labels[0], (None, 1, 1)], "doc_id long, mean int, toxic int")
    vocabulary, chain = toxicity.train(docs, marks, ["mean", "toxic"], train_rows=300)
    assert len(chain) == 2 and len(chain[1].dense) == 2
    got = {r.doc_id: r for r in toxicity.score(docs, vocabulary, chain, ["mean", "toxic"]).collect()}
    held_out = [x for x in labels if x[0] >= 400]
    assert sum((got[d].p_toxic > 0.5) == bool(t) for d, _, t in held_out) >= 0.97 * len(held_out)
    assert sum((got[d].p_mean > 0.5) == bool(m) for d, m, _ in held_out) >= 0.95 * len(held_out)
    assert len(got) == 603 and got[600].p_toxic == got[601].p_toxic
    again = toxicity.train(docs, marks, ["mean", "toxic"], train_rows=300)
    assert again[0] == vocabulary and (again[1][1].weights == chain[1].weights).all()


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b")], DOCS)
    vocabulary, chain = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"), ["toxic"])
    assert [r.p_toxic for r in toxicity.score(docs, vocabulary, chain, ["toxic"]).collect()] == [0.5, 0.5]
    assert toxicity.score(docs.limit(0), vocabulary, chain, ["toxic"]).count() == 0


def test_toxicity_held_out(spark):
    """On the test tables: trained on half of the labels, judged on the other half."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    marks = toxicity.category_labels(docs, labels).filter("doc_id % 2 = 0")
    categories = [*toxicity.CATEGORY_WORDS, "toxic"]
    scored = toxicity.score(docs, *toxicity.train(docs, marks, categories), categories)
    held_out = scored.join(labels.filter("doc_id % 2 = 1"), "doc_id").select("p_toxic", "toxic").collect()
    assert sum((r.p_toxic > 0.5) == bool(r.toxic) for r in held_out) >= 0.95 * len(held_out)
    toxic = [r for r in held_out if r.toxic]
    assert sum(r.p_toxic > 0.5 for r in toxic) >= 0.85 * len(toxic)


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.callables()) == list(range(1, 11))
