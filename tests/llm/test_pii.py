import os
import re

import numpy as np
import pytest

from tideglass.llm import pii_labels as L
from tideglass.llm.pii import KINDS, LABELS, LONGEST, Crf, compact, cuts, default_model, expand, find_personal, find_spans, redact, redacted, store, stream, train
from tideglass.llm.queries import PROJECTS

DOCS = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def model():
    return default_model()


#: Sentences written apart from the labelled table; no name, street or host of theirs stands in its lists.
APART = [
    ("Minutes taken by Michael Johnson and Priya Patel.", ["N:Michael Johnson", "N:Priya Patel"]),
    ("My manager Sarah O'Connell approved the leave.", ["N:Sarah O'Connell"]),
    ("Dr. Wei Zhang will join us later.", ["N:Wei Zhang"]),
    ("Barack Obama spoke in Berlin.", ["N:Barack Obama"]),
    ("Herr Klaus Schmidt ist heute nicht da.", ["N:Klaus Schmidt"]),
    ("Guillaume Lefevre a signé le contrat.", ["N:Guillaume Lefevre"]),
    ("Fatima Al-Hassan sent the documents.", ["N:Fatima Al-Hassan"]),
    ("The invoice was paid by Ravi Krishnan last Tuesday.", ["N:Ravi Krishnan"]),
    ("La señora Elena Castillo llegó tarde.", ["N:Elena Castillo"]),
    ("Please call Oliver Bennett on +44 161 496 0000 tomorrow.", ["N:Oliver Bennett", "P:+44 161 496 0000"]),
    ("Rechnung an Jutta Brandt, Lessingstraße 14, 04109 Leipzig.", ["N:Jutta Brandt", "A:Lessingstraße 14"]),
    ("The keys are with Hannah Whitfield at reception.", ["N:Hannah Whitfield"]),
    ("Contrat remis à Bernard Lacroix le 3 mai.", ["N:Bernard Lacroix"]),
    ("Preguntad a Ignacio Robles por la llave.", ["N:Ignacio Robles"]),
    ("Write to maria_garcia@empresa.es please", ["E:maria_garcia@empresa.es"]),
    ("Her login is j.whitfield42@northmail.co.uk now", ["E:j.whitfield42@northmail.co.uk"]),
    ("send it to bob [at] shop [dot] net", ["E:bob [at] shop [dot] net"]),
    ("Il habite 12 rue de Rivoli, Paris.", ["A:12 rue de Rivoli"]),
    ("She lives at 9 Willow Crescent.", ["A:9 Willow Crescent"]),
    ("Call 030 901820 now", ["P:030 901820"]),
    ("Passport number 533401234 was lost", ["D:533401234"]),
    ("Her SSN is 078-05-1120, on file.", ["D:078-05-1120"]),
    ("ring (303) 555-0142 or 303-555-0199 x7", ["P:(303) 555-0142", "P:303-555-0199"]),
]
NONE = ["Send mail to P.O. Box 4123.", "IBAN GB29 NWBK 6016 1331 9268 19", "Table 12 shows the Monte Carlo error of 0.431.", "The Bank of England left rates unchanged in March.", "Der Bericht nennt 14 Fehler im Lager.", "build 7.12.443 of lot 555-12-9876", ""]


def score(model, rows):
    """Cases, found cases, found spans, by start and kind."""
    n = hit = got = 0
    for (text, want), spans in zip(rows, find_spans(model, [t for t, _ in rows])):
        w = {(k.split(":", 1)[0], text.index(k.split(":", 1)[1])) for k in want}
        g = {(k, a) for a, _, k in spans}
        n, hit, got = n + len(w), hit + len(w & g), got + len(g)
    return n, hit, got


def test_sentences_written_apart(model):
    n, hit, got = score(model, APART)
    assert hit / n >= 0.9 and hit / got >= 0.9
    names = [(t, [k for k in want if k[0] == "N"]) for t, want in APART]
    n, hit, _ = score(model, names)
    assert hit / n >= 0.85
    assert score(model, [(t, []) for t in NONE])[2] == 0


def test_names_of_no_list(model):
    """The table's patterns with name words that are all made anew from another seed."""
    rows = L.labelled(seed=4321, each=3, made=1.0, loose=300, salad=0)
    hit = miss = wrong = 0
    for (_, spans), got in zip(rows, find_spans(model, [t for t, _ in rows])):
        a, b = {(s, k) for s, _, k in spans}, {(s, k) for s, _, k in got}
        hit, miss, wrong = hit + len(a & b), miss + len(a - b), wrong + len(b - a)
    assert hit / (hit + miss) > 0.9 and hit / (hit + wrong) > 0.9


@pytest.mark.skipif(not os.path.exists(DOCS), reason="no test tables here")
def test_table_shares_nothing_with_the_documents():
    import pyarrow.parquet as pq

    text = "\n".join(pq.read_table(DOCS, columns=["text"])["text"].to_pylist())
    for p in L.SENTENCES + L.PLAIN:
        for piece in re.split(r"{\w}", p):
            if len(re.findall(r"\w+", piece)) >= 5:
                assert piece.strip() not in text, piece
    words = set(re.findall(r"\w+", text))
    people = {w for w in L.FIRST + L.LAST if w in words}
    assert people <= {"Mark", "Paul", "Young", "King", "Green", "White", "Black", "Brown", "Bell", "Cook", "Min", "Rose", "Park", "Taylor", "May", "Jun", "Lange", "Klein", "Carlo", "Harris", "Costa"}, people
    assert not [h for h in L.HOSTS if h in text]


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(40):
        crf = Crf(3, {})
        crf.move = rng.normal(size=(3, 3)).astype(np.float32)
        scores = rng.normal(size=(9, 3)).astype(np.float32)
        scores[:, 0] += trial / 10  # so that some sequences need no decoding
        got = crf.viterbi(scores, np.array([4, 5, 9]))
        for lo, hi in ((0, 4), (4, 5), (5, 9)):
            best = max(np.ndindex(*(3,) * (hi - lo)), key=lambda y: sum(scores[lo + t, y[t]] for t in range(hi - lo)) + sum(crf.move[y[t - 1], y[t]] for t in range(1, hi - lo)))
            assert tuple(got[lo:hi]) == best


def test_stream_equals_a_plain_reading():
    text = "a1 Łé x@y.org, (030) 12-3\n\n𝒜b 😀c 0,5\t+1 20 30. end"
    s = stream(text)
    want = [m.span() for m in re.finditer(r"[^\W\d_]+|\d+|\n|[^\s]", text)]
    assert list(zip(s.start.tolist(), s.end.tolist())) == want
    chunks = [text[a:b] for a, b in zip(s.chunk_at, s.chunk_end)]
    assert chunks == ["a1", "Łé", "x@y.org", "(030)", "12-3", "𝒜b", "😀c", "0,5", "+1", "20", "30", "end"]
    assert [text[a:b] for a, b in zip(s.run_at, s.run_end)] == ["(030) 12-3", "+1 20 30"]
    again = stream("zz " + text)
    assert again.word[1:].tolist() == s.word.tolist() and again.run_hash.tolist() == s.run_hash.tolist()
    assert stream("ask Old Kettle now", ("Old Kettle",)).known.tolist() == [0, 1, 1, 0]
    assert len(stream("").start) == 0


def test_spans_and_placeholders(model):
    text = "Signed by Dr. Hannah Whitfield.\nwrite to h.whitfield@northmail.org or +1 (303) 555-0113 please\nBrindle North studied the lot 751-87-3625."
    spans = find_spans(model, [text], PROJECTS)[0]
    assert [(KINDS[k], text[a:b]) for a, b, k in spans] == [("name", "Hannah Whitfield"), ("email", "h.whitfield@northmail.org"), ("phone", "+1 (303) 555-0113")]
    assert redacted(text, spans) == "Signed by Dr. [NAME].\nwrite to [EMAIL] or [PHONE] please\nBrindle North studied the lot 751-87-3625."


def test_cases_of_tables(spark, model, rows):
    long = "We set the limit at 0.396 after the call and did not change it. " * 3000 + "Signed: Hannah Whitfield"
    data = [(1, "Signed: Hannah Whitfield"), (1, "Signed: Hannah Whitfield"), (2, ""), (3, None), (None, "Signed: Hannah Whitfield"), (4, long)]
    df = spark.createDataFrame([(i, t, "k") for i, t in data], "doc_id long, text string, kind string")
    got = rows(find_personal(df, "doc_id", "text", model))
    assert got == sorted([(1, "name", 8, 24), (1, "name", 8, 24), (4, "name", len(long) - 16, len(long))], key=repr)
    assert (4, 1) in [(r.doc_id, r.spans) for r in redact(df, "doc_id", "text", model).collect()]
    assert find_personal(df.limit(0), "doc_id", "text", model).count() == 0
    assert find_spans(model, []) == [] and find_spans(model, ["", "\n"]) == [[], []]


def test_weights_survive_sending_and_storing(model, tmp_path):
    text = ["Signed: Hannah Whitfield"]
    assert find_spans(expand(compact(model)), text) == find_spans(model, text) and len(LABELS) == 11
    store(model, tmp_path / "w.npz")
    with np.load(tmp_path / "w.npz") as z:
        again = expand({**{k: z[k].astype(np.float32) for k in ("w", "flag", "known", "move")}, "slot": z["slot"], "lexicon": model.lexicon})
    assert find_spans(again, text) == find_spans(model, text)


def test_training_learns_a_small_table():
    rows = [(f"signed {n} here", [(7, 7 + len(n), "N")]) for n in ("Ada Lovel", "Bob Grind", "Cy Moss")] * 8 + [("signed it here", [])] * 8
    crf = train(rows, epochs=8, lexicon={})
    assert find_spans(crf, ["signed Ada Lovel here"]) == [[(7, 16, "N")]] and find_spans(crf, ["signed it here"]) == [[]]


def test_cuts_cover_the_text():
    s = stream("word " * 1500 + "\nends there. Next one")
    ends = cuts(s)
    assert ends[-1] == len(s.start) and max(np.diff([0, *ends])) <= LONGEST
    assert len(cuts(stream("It ends there. Next one"))) == 2
