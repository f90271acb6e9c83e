import hashlib
import random
import re

from memlake.llm import pii

DOCS = "doc_id long, text string, mark long, base string"


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0


def card(m):
    d = re.sub("[^0-9]", "", m[0])
    return 12 <= len(d) <= 19 and luhn(d)


KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", card),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
)


def base(text):
    found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, good) in enumerate(KINDS) for m in re.finditer(p, text or "") if good(m)]
    return [x[2] for x in sorted(found)]


def check(rows, got):
    for i, t in rows:
        want, r = base(t), got[i]
        assert [s for s in r["spans"].split(",") if s and not s.startswith(("remove", "generalise"))] == want, t
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k[0]}"] for k in KINDS] == [sum(s.startswith(k[0]) for s in want) for k in KINDS]


def test_base_spans_are_brute_force(spark):
    rng = random.Random(8)
    parts = ["a", "b.c", "@", "@x.y", "_", ".", "..", "-", " ", "  ", "\n", "é", "😀", "+1", "+", "(0", ")", "555", "12", "4539578763621486", "4539 5787 6362-1486", "256", "1.2.3.4", "192.168.0.1", "0", "9", "00", "%", "٣"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += [None, "", "1 " * 30000, "1" * 60000, "a" * 60000, "a@" + "b." * 20000, "1." * 30000, "+1" + "-" * 30000, "a@b.c " * 2000]
    rows = list(enumerate(texts)) + [(None, "x@y.z")]
    got = {r["doc_id"]: r for r in pii.personal_digest(spark.createDataFrame([(*r, 1, "b") for r in rows], DOCS)).collect()}
    assert len(got) == len(rows)
    check(rows, got)


def test_disclosing_terms(spark):
    rng = random.Random(6)
    filler = lambda: " ".join(rng.choice(["river", "stone", "bridge", "house"]) for _ in range(8))
    rows = [(i, f"{filler()}\n{filler()} Quibblethwaite {i} wrote to q@mail.org {filler()}\nQuibblethwaite alone") for i in range(8)]
    rows += [(100 + i, f"{filler()} wrote to m{i}@mail.org") for i in range(40)] + [(200 + i, filler()) for i in range(140)] + [(3, rows[3][1])]
    found = pii.find_personal_data(spark.createDataFrame([(*r, 1, "b") for r in rows], DOCS))
    got = [(r["doc_id"], r["text"][s["start"] : s["end"]], s["kind"]) for r in found.collect() for s in r["found"] if s["ord"] > 3]
    assert sorted(got) == sorted((i, "Quibblethwaite", got[0][2]) for i in [3, *range(8)])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(found).collect()}
    assert "q@mail.org" not in clean[0] and "[EMAIL]" in clean[0] and clean[0].count("Quibblethwaite") == 1


def test_terms_of_rare_entities_anywhere_in_the_document(spark):
    texts = [f"river stone bridge {'house' if i % 2 else 'water'} {'plain' if i % 3 else 'green'}" for i in range(120)]
    texts[0] += "\nwrite to a@mail.org\nThe Zanzibari said, email me"  # one document: all its own terms are generalised
    for k in (1, 2):
        texts[k] += f"\nQuibble{'x' * k} river\n10.0.0.1 Thwaite"  # two documents share an address and a term
    for k in range(3, 9):
        texts[k] += "\nsame line +1 (555) 123-4567 here\nlegal"  # copies of one line
    rows = [(i, t, 1, "b") for i, t in enumerate(texts)] + [(None, texts[1], 1, "b")]

    held = [{*re.findall(r"[a-z@.]+@[a-z.]+|\d+(?:\.\d+){3}|\+1.*\d", r[1])} for r in rows]
    terms = [{w.lower() for w in re.findall("[A-Za-z]{3,}", re.sub(r"\S+@\S+", "", r[1]))} for r in rows]
    want = set()
    for i, r in enumerate(rows):
        for m in re.finditer("[A-Za-z]{3,}", r[1]):
            w, best = m[0].lower(), 0
            for e in held[i]:
                n_e = sum(e in h for h in held)
                both, n_t = sum(e in h and w in t for h, t in zip(held, terms, strict=True)), sum(w in t for t in terms)
                share = (both + 2 * n_e / len(rows)) / (n_t + 2)
                best = max(best, (share >= 0.25) + (share >= 0.5) if share * len(rows) / n_e >= 8 else 0)
            if best and "@" not in r[1][m.start() - 2 : m.end() + 1] and r[1][m.start() - 1 : m.start()] != ".":
                want.add((r[0], ("", "generalise", "remove")[best], m.start(), m.end()))
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.personal_digest(spark.createDataFrame(rows, DOCS)).collect()}
    spans = {(i, k, int(a), int(b)) for i, x in got.items() for k, a, b in (s.split(":") for s in x if s) if k in ("remove", "generalise")}
    assert spans == want
    assert {texts[1 if i is None else i][a:b] for i, _, a, b in spans} >= {"Zanzibari", "email", "Thwaite", "same", "legal"}


def test_nothing(spark):
    assert pii.personal_digest(spark.createDataFrame([], DOCS)).count() == 0


def test_terms_too_common_to_disclose_are_not_shuffled_with_entities(spark):
    from test_similarity import shuffled

    words = " ".join(f"{a}{b}word" for a in "abcdefghij" for b in "abcdefghijklmnopqrst")
    docs = spark.createDataFrame([(k, f"{words} own{chr(97 + k % 26)}{chr(97 + k // 26)} mail{k}@example.org") for k in range(60)], "doc_id long, text string")
    rows, n = shuffled(spark, lambda: pii.find_personal_data(docs, by_line=False).collect())
    assert {len(r["found"]) - len(r["base"]) for r in rows} == {1}  # the word of its own
    assert n < 6000  # entities with every term would be 12000 rows, several times
