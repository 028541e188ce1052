import hashlib
import random
import re
import time

import pytest

from siftwise.llm import pii
from tests.llm.helpers import corpus, documents, real


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base(text):
    """Spans by the stated patterns, with plain quantifiers."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok) in rules.items()}


ODD = [
    "mail a@b.c_x@d.e and x.y%z+1@host-1.example.com, @no.one a@b",
    "😀 ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.255 9.9.9",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 5555555555554444 12 34 56 78 90 12 34 56 7",
    "call +1 (743) 555-3824. or +44 20 7946 0958 +1 +12 3 ++3 +123456789012345678",
    "1" * 3000 + " " + "a." * 2000 + "@" + "b." * 900 + "c",
    "+" * 500 + "1" * 40,
]


def check(docs):
    rows = {(r["doc_id"], i): r for i, r in enumerate(docs.collect())}
    found = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    for (i, _), row in rows.items():
        spans, got = base(row["text"]), found[i]
        assert [got[f"n_{k}"] for k in pii.KINDS] == [len(spans[k]) for k in pii.KINDS]
        listed = [f"{k}:{a}:{b}" for k in pii.KINDS for a, b in spans[k]]
        assert got["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [s for s in got["spans"].split(",") if s and not s.startswith("term:")] == listed
    return found


def test_odd_texts(spark):
    check(documents(spark, [*ODD, *corpus()]))


def test_real_documents(spark):
    check(real(spark))


@pytest.fixture(scope="module")
def gossip(spark):
    """A nickname that stands by one address only, a word that stands by many, and copies of one text."""
    texts = [f"note {w} from Zorgblat writing to zed@example.org about {w}" for w in ("apples", "pears", "plums", "figs")]
    texts += [f"write to someone{k}@example.org please" for k in range(6)] + ["please come", "zorgblat was here, ZORGBLAT again"]
    texts += ["copied quixotic text for kim@example.net today"] * 9
    return documents(spark, texts)


def test_terms_that_disclose(spark, gossip):
    rows = {r["doc_id"]: r for r in pii.find_personal_data(gossip).collect()}
    terms = {i: [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("term:")] for i, r in rows.items()}
    texts = {r["doc_id"]: r["text"] for r in gossip.collect()}
    words = {texts[i][a:b].lower() for i, spans in terms.items() for a, b in spans}
    assert "zorgblat" in words and "please" not in words and "quixotic" not in words
    assert len([1 for a, b in terms[11] if texts[11][a:b].lower() == "zorgblat"]) == 2


def test_sanitised_documents(spark, gossip):
    clean = pii.sanitise(gossip)
    assert clean.columns == gossip.columns
    rows = {r["doc_id"]: r for r in clean.collect()}
    assert len(rows) == gossip.count()
    assert "zed@" not in rows[0]["text"] and "[EMAIL]" in rows[0]["text"] and "zorgblat" not in rows[11]["text"].lower()
    assert rows[10]["text"] == "please come" and rows[10]["n_chars"] == 11
    assert clean.filter(~pii.no_personal_data(clean["text"])).count() == 0


def test_overlapping_kinds_are_replaced_once(spark):
    docs = documents(spark, ["x +4111111111111111@host.com y", None, "4111 1111 1111 1111"])
    assert [r["text"] for r in pii.sanitise(docs).orderBy("doc_id").collect()] == ["x [EMAIL] y", None, "[CARD]"]


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["a@b.c", "a@b.c", None, None], ids=[1, 1, None, None])
    assert sorted(r["n_email"] for r in pii.find_personal_data(docs).collect()) == [0, 0, 1, 1]
    assert pii.find_personal_data(docs.limit(0)).count() == 0 and pii.sanitise(docs.limit(0)).count() == 0


def test_a_document_counts_once(spark):
    """One text names an address in many surroundings; the word beside it stands in nine other texts too."""
    log = "\n".join(f"{w}one {w}two billing ops@example.org {w}four {w}five" for w in ("red", "blue", "green", "brown", "black"))
    docs = documents(spark, [log, *[f"billing matter of {w}" for w in "abcdefghi"]])
    assert [r["n_term"] for r in pii.find_personal_data(docs).orderBy("doc_id").collect()][1:] == [0] * 9


def test_short_words_and_handles_are_terms(spark):
    names = ("Lee", "李明", "bob42", "नमः")
    fruit = ("apples", "pears", "plums", "figs")
    texts = [f"note {w}: {n} <box{k}@example.org> likes {w}" for k, n in enumerate(names) for w in fruit]
    rows = pii.find_personal_data(documents(spark, [*texts, *names])).orderBy("doc_id").collect()
    assert [r["spans"] for r in rows[len(texts) :]] == [f"term:0:{len(n)}" for n in names]


def test_neighbourhood_is_cut_at_words(spark):
    """No part of a word that the bound cuts is a term; the same words by themselves stay."""
    half = "k" * (pii.NEAR_CHARS - 1)
    texts = [f"{w} tail{half} a@b.org {half}tail {w}" for w in ("one", "two", "six", "ten")]
    rows = pii.find_personal_data(documents(spark, [*texts, half])).orderBy("doc_id").collect()
    assert rows[-1]["n_term"] == 0


def test_very_many_spans_in_one_text(spark):
    """100,000 addresses in one text: found and rewritten in a time that does not grow with their square."""
    n = 100_000
    text = "".join(f"write to u{i}@mail{i % 7}.example.org now\n" for i in range(n))
    docs = documents(spark, [text, "nothing here"])
    begun = time.perf_counter()
    rows = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    assert rows[0]["n_email"] == n and rows[1]["n_found"] == 0
    listed = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"u[0-9]+@mail[0-9]\.example\.org", text)]
    assert rows[0]["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
    clean = pii.sanitise(docs).filter("doc_id = 0").first()["text"]
    assert clean.count("[EMAIL]") == n and "@" not in clean
    assert time.perf_counter() - begun < 180


def test_columns_named_as_the_operators_own(spark):
    docs = documents(spark, ["mail a@b.org", "x"]).selectExpr("*", "1 AS _text", "2 AS _doc", "3 AS _clean", "4 AS _edits", "5 AS _row", "6 AS spans", "7 AS term_spans")
    clean = pii.sanitise(docs).orderBy("doc_id").collect()
    assert [r["text"] for r in clean] == ["mail [EMAIL]", "x"] and clean[0].asDict()["_edits"] == 4 and pii.sanitise(docs).columns == docs.columns
    assert pii.find_personal_data(docs).count() == 2


def shares(texts):
    """Terms near entities, with the documents that have both over all with the term; in plain Python."""
    word, near, support, with_entity = re.compile(r"[^\W_]+"), pii.NEAR_CHARS, {}, {}
    for i, text in enumerate(texts):
        for kind, spans in base(text).items():
            for a, b in spans:
                left, right = text[max(0, a - near) : a], text[b : b + near]
                if a > near and re.match(r"[^\W_]", text[a - near - 1]):
                    left = re.sub(r"^[^\W_]+", "", left)
                if b + near < len(text) and re.match(r"[^\W_]", text[b + near]):
                    right = re.sub(r"[^\W_]+$", "", right)
                terms = word.findall(left.lower())[-pii.NEAR_WORDS :] + word.findall(right.lower())[: pii.NEAR_WORDS]
                for t in terms:
                    pair = (f"{kind}:{text[a:b].lower()}", t)
                    support.setdefault(pair, set()).add(tuple(terms))
                    with_entity.setdefault(pair, set()).add(i)
    documents_with = {}
    for text in texts:
        for t in set(word.findall((text or "").lower())):
            documents_with[t] = documents_with.get(t, 0) + 1
    most = {}
    for (e, t), docs in with_entity.items():
        if len(support[e, t]) >= pii.MIN_SUPPORT:
            most[t] = max(most.get(t, 0), len(docs))
    return {t: n / documents_with[t] for t, n in most.items() if n / documents_with[t] >= pii.GENERALISE}


def test_term_spans_against_brute_force(spark):
    draw = random.Random(4)
    names = ["Mira", "Oto", "kel77", "Zu"]
    texts = []
    for _ in range(160):
        words = [draw.choice(["sun", "moon", "river", "stone", "ask", "for"]) + draw.choice(["", "s", "ly"]) for _ in range(draw.randint(3, 30))]
        k = draw.randrange(4)
        if draw.random() < 0.5:
            words.insert(draw.randrange(len(words)), f"{names[k]} {names[k].lower()}@post.example")
        elif draw.random() < 0.3:
            words.insert(draw.randrange(len(words)), draw.choice(names))
        texts.append(" ".join(words) + draw.choice(["", "\nsecond line of Mira"]))
    found = shares(texts)
    assert found
    pattern = re.compile("|".join(rf"(?<![^\W_]){re.escape(t)}(?![^\W_])" for t in sorted(found)), re.I)
    rows = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        want = [f"term:{m.start()}:{m.end()}" for m in pattern.finditer(text)]
        assert [s for s in rows[i].split(",") if s.startswith("term:")] == want, text
