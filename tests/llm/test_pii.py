import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import pii
from plumbline.llm.pii_table import labelled


@pytest.fixture(scope="module")
def model():
    return pii.trained()


def run(model, texts):
    read = [pii.tokens(t) for t in texts]
    return [pii.items(t, *r, y) for t, r, y in zip(texts, read, pii.Decoder(model).labels(read))]


def agreement(model, table):
    """(precision, recall) of whole items."""
    right = found = due = 0
    for (_, want), got in zip(table, run(model, [t for t, _ in table])):
        right, found, due = right + len(set(got) & set(want)), found + len(got), due + len(want)
    return right / found, right / due


#: Written for this test, apart from the table's sentences: N, E, P, I and A in double brackets mark the items.
OTHER = """
Hi team, [[N:Rebecca Holloway]] from the Denver office will cover for me next week. Her cell is [[P:(415) 555-0132]] and her mail is [[E:rebecca.holloway@northgate-labs.com]].
Please update my file: new address [[A:48 Birchwood Avenue, Portland 97205]], old one [[A:7 Mill Lane]]. My SSN is [[I:078-05-1120]].
The plumber, Mr [[N:Okonkwo]], rang from [[P:+44 20 7946 0018]] and left no message.
Landlord: [[N:Tomasz Zieliński]]. Tenant: [[N:Grace Adeyemi]]. The deposit of $1,450 was paid on 3 June 2019 into account 66302-118.
Apache Spark and Delta Lake were both installed on Monday; the licence server for Oracle was not.
Dr. [[N:Helena Brandt]] saw the patient twice. NHS number [[I:943 476 5919]] was on the wristband.
Die Wohnung in der [[A:Lindenstraße 14, 50674 Köln]] gehört [[N:Jürgen Kessler]], erreichbar unter [[P:0221 / 470 11 23]].
Frau [[N:Öztürk]] hat den Termin am 12.04.2021 abgesagt. Bitte an [[E:service@kanzlei-brenner.de]] antworten.
Madame [[N:Lefebvre]] habite [[A:23, rue des Lilas, 69003 Lyon]] et son téléphone est le [[P:04 72 61 88 09]].
Numéro de sécurité sociale [[I:2 85 07 69 123 456]], passeport délivré à [[N:Camille Aubert]].
In Henderson Shipping Ltd v. Port of Tyne Authority [2004] EWCA 311 the freighter Northern Dawn had struck the pier in Marlow Street.
The purchase order 4500-98812 and invoice no. 20-3391 from Kessler Maschinenbau GmbH are still open.
[[N:Whitfield]] refused to answer. [[N:Marchetti]], however, spoke for an hour.
The parcel goes to [[N:D. Fairbanks]], [[A:Flat 3, 112 Harbour Road, Leith EH6 7JT]], before Friday.
Contact [[E:j.novak [at] mailbox [dot] org]] or the switchboard at [[P:+1 212-555-0199]] about ticket 88-104.
Under section 14 of the Harbours Act the fee is 20 euros; the Gregson doctrine says otherwise.
Judge [[N:Amelia Stone]] dismissed the claim of [[N:Victor Hale]] against Brightwater Holdings on 9 May 2011.
The witness [[N:Farid Mansouri]] lives at [[A:9 Orchard Close, Ripon]], next to the church in Kirkby Road.
"""
LETTER = dict(zip("NEPIA", pii.KINDS))


def marked(line):
    text, spans, at = "", [], 0
    for m in re.finditer(r"\[\[(\w):(.*?)\]\](?!\])", line):
        text += line[at : m.start()]
        spans.append((len(text), len(text) + len(m[2]), LETTER[m[1]]))
        text, at = text + m[2], m.end()
    return text + line[at:], spans


def test_held_out(model):
    precision, recall = agreement(model, list(labelled(3, seed=123)))
    assert precision > 0.95 and recall > 0.95


def test_text_of_another_kind(model):
    precision, recall = agreement(model, [marked(x) for x in OTHER.strip().split("\n")])
    print("other text", precision, recall)
    assert precision > 0.7 and recall > 0.7


def test_tokens_cover_the_text():
    for text in ["", " ", "a  b\n\n(c)", "x@y.z, <k@l>; 'q' ²½ 🙂­-"]:
        toks, gaps = pii.tokens(text)
        assert "".join(g + t for g, t in zip(gaps, [*toks, ""])) == text
        assert all(text[b : b + len(t)] == t for t, b in zip(toks, pii.begins(toks, gaps)))


def test_sentences_are_decoded_apart(model):
    """A text is decoded in pieces that end with a sentence, and pieces without any sign of an item are passed over. Passing over changes nothing;
    one Viterbi over whole texts gives other labels in less than one text of two hundred."""
    table = [text for text, _ in labelled(2, seed=5)]
    whole = other = 0
    for text in table:
        d = pii.Decoder(model)
        read = [pii.tokens(text)]
        got = d.labels(read)[0]
        d.gain = 1e9  # nothing is passed over
        assert list(d.labels(read)[0]) == list(got)
        d.stop = np.zeros_like(d.stop)  # no piece ends before the text
        whole, other = whole + 1, other + (list(d.labels(read)[0]) != list(got))
    assert whole > 500 and other / whole < 0.005, (other, whole)


def test_table(spark, model):
    text = "Call +999 12 3456 7890 and ask for Dulmar\nVestrin. Mobile: [telephone].\nThe policy (CNT 123 456 7) covers Vestrin Works only. Mr Vestrin's claim was refused.\nE-mail: d.vestrin [at] mail [dot] test; the owner was X."
    long = "The reasons are short. " * 40000 + "Mr Holmar and Mrs Trissen disagreed."
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, " \n"), (5, long), (None, "Herr Holmar schwieg."), (1, text)], "doc_id long, text string").withColumn("items", F.lit(1))
    rows = pii.find(docs).collect()
    assert len(rows) == 7
    by = {r.doc_id: r for r in rows}
    assert by[2].text is None and by[2].items == [] and by[3].text == "" and by[4].text == " \n"
    assert [(i.kind, i.value) for i in by[1].items] == [("phone", "+999 12 3456 7890"), ("name", "Dulmar Vestrin"), ("name", "Vestrin"), ("email", "d.vestrin [at] mail [dot] test")]
    assert by[1].text == re.sub(r"d\.vestrin.*test", "[EMAIL]", text.replace("+999 12 3456 7890", "[PHONE]").replace("Dulmar\nVestrin", "[NAME]").replace("Vestrin's", "[NAME]'s"))
    assert by[5].text == long.replace("Holmar", "[NAME]").replace("Trissen", "[NAME]")
    found = {tuple(r) for r in pii.found_items(docs).collect()}
    assert {f for f in found if f[0] is None} == {(None, "name", "Holmar")} and len(found) == 7
    assert pii.find(docs.limit(0)).count() == 0
