"""Sentence ends: marked by ¶ in the expected text, which is otherwise the input."""

import sys

import pytest
from pyspark.sql import functions as F

from sigweave.llm import sentences as S
from sigweave.llm.repair import repair


def cues(*texts):
    return "".join(f"{k}\n00:00:{k:02d},000 --> 00:00:{k:02d},900\n{t}\n\n" for k, t in enumerate(texts, 1))


def expect(text):
    want = [k - n - 1 for n, k in enumerate([i for i, c in enumerate(text) if c == "¶"])]
    return text.replace("¶", ""), want


CASES = {
    "plain and wrapped": ["It is late.¶ Who fed\nthe herons?¶", "Not again!!¶"],
    "abbreviations": ["Prof. J. R. Ludovarn met Dr. Hill at 10:45 a.m. every day.¶", "Tolva & Sons Ltd. slept.¶ See fig. 3, vol. 2, etc. and p. 12.¶"],
    "time at the end": ["We left at 5 p.m.¶ Come here.¶"],
    "decimals and ordinals": ["Das kostet 3,5 Taler, bzw. 2.25.¶ Am 3. Mai war es still.¶"],
    "runs on in small letters": ["Keep your voice", "down...¶"],
    "runs on over dots": ["Tu ne m’as dit qui était...", "...derrière le moulin ?!¶"],
    "trailing comma or dash": ["El afinador vendió la bicicleta –", "azul.¶", "Marwenna cantó,", "Brannik durmió.¶"],
    "no mark": ["Come here¶", "Thank you.¶"],
    "speakers": ["- Come here¶\n- Why?¶", "TOLVA: Wait.¶\nMAN 2: No¶"],
    "sounds inside and alone": ["Her brother (or so they say...)\nfollowed the cart.¶", "[Music playing. Crowd cheers.]", "♪ slow waltz ♪ Thank you.¶", "*thunder*"],
    "quoted inside": ["“Stop!” Skazesa shouted\nat the salt works.¶", "He said \"no.\" and missed it.¶", "The sign reads \"Keep out!\nWet paint.\" in the shed.¶"],
    "quoted whole": ["“Fine, but he signed it.”¶ «No.»¶"],
    "french quotes": ["Mukaux dit : « Attends. Ne bouge\npas. » et a raté le signal.¶", "« Il est là ? »¶"],
    "spanish": ["¿La Dra. Talirek y Ud.\nestaban allí?¶ «¡Alto!», gritó Erkasa.¶"],
    "russian": ["Т. е. Толва ждёт.¶ «Стой!» — крикнул паромщик.¶", "Проф. А. Б. Толва ищет, и т. д., ключи.¶"],
    "chinese": ["“站住！”奎尔多喊道？¶不行。¶", "《别走！》那本书在水泵旁边。¶", "那个……房东走了。¶"],
    "japanese": ["「止まれ！」とエスリンが叫んだ！¶だめだ｡¶", "あの…大家さんが来た。¶"],
    "arabic and hindi": ["تعال هنا؟¶ لا.¶", "इधर आओ।¶ डॉ. नाविक आया॥¶"],
    "hesitations": ["Well... the clerk slept.¶", "Eh bien... Marwenna a vendu le vélo.¶"],
    "adverts": ["Subtitles by m1llwheel", "Visit www.gooseteam.example for free subs. No sign-up. No fee.", "Write to mill-house.example\nand ask for Tolva.¶"],
    "mark-up": ["<i>Come here.¶</i>", "{\\an8}<b>Thank you</b>.¶"],
    "url and initials": ["The U.N.R. office closed.¶"],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    text, want = expect(cues(*CASES[name]))
    got = S.sentence_ends(text)
    show = lambda e: [text[max(0, k - 12) : k + 1] for k in e]
    assert got == want, (show(got), show(want))


@pytest.mark.parametrize("codec,shown", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("cp1251", "latin-1"), ("gb2312", "latin-1")])
def test_wrong_encodings_keep_positions(codec, shown):
    plain = {"cp1251": ["Ты не сказал, кто был у канала.¶ Нет…¶", "Иди сюда!¶"], "gb2312": ["我想房东把船漆了两遍了吧。¶", "“站住！”奎尔多喊道。¶"]}.get(codec, ["Überall läuft das Mädchen…¶", "Ça coûte 3 écus.¶ « Où ? »¶"])
    clean, want = expect(cues(*plain))

    def garble(t):
        out = ""
        for b in t.encode(codec):
            try:
                out += bytes([b]).decode(shown)
            except UnicodeDecodeError:
                out += chr(b)
        return out

    bad = garble(clean)
    got = S.sentence_ends(bad)
    assert got == [len(garble(clean[: k + 1])) - 1 for k in want]


def test_twice_wrong_and_entities():
    clean, want = expect(cues("Ça va, m’dame ?¶ « Où est Élodie ? »¶", "Très bien.¶"))
    twice = clean.encode().decode("latin-1").encode().decode("latin-1")
    assert S.sentence_ends(twice) == [len(clean[: k + 1].encode().decode("latin-1").encode().decode("latin-1")) - 1 for k in want]
    e = cues('He said &quot;no.&quot; and left.', "&quot;Come here.&quot;")
    assert [e[k] for k in S.sentence_ends(e)] == [".", ";"]
    assert repair("plain text").end(3) == 3


def test_odd_texts():
    assert S.sentence_ends(None) == S.sentence_ends("") == S.sentence_ends("﻿") == S.sentence_ends("\n\n1\n") == []
    assert S.sentence_ends("No cues here. Only text") == [12, 22]
    long = cues(*["Come here. Who said so?"] * 60)
    assert len(S.sentence_ends(long)) == 120
    assert len(S.sentence_ends("a" * 200_000)) == 1
    crlf, want = expect(cues("It is late.¶", "Come here¶").replace("\n", "\r\n"))
    assert S.sentence_ends(crlf) == want
    lost, want = expect("00:00:01.000 -> 00:00:02.000\nIt is late.¶\n \n7\n00:00:03,000 --> 00:00:04,000\nNo.¶\n")
    assert S.sentence_ends(lost) == want


def test_document_and_corpus_evidence():
    text, want = expect(cues("Olym. valley is far.¶", "We saw the olym. valley.¶ The olym. Brannik fell.¶"))
    stats = S.Stats()
    into = {}
    for _ in range(10):
        S.count_words(text, into)
    for k, v in into.items():
        stats.counts[k // S.KINDS, k % S.KINDS] = v
    assert S.sentence_ends(text, stats) == want


def test_over_documents(spark):
    rows = [(1, cues("It is late.")), (2, None), (3, ""), (4, cues("Come here", "Thank you.")), (4, cues("No."))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("end_pos", F.lit(0)).withColumn("k", F.lit(0))
    got = sorted(map(tuple, S.split_sentences(docs).collect()))
    assert [g[0] for g in got] == [1, 4, 4, 4]
    assert S.split_sentences(docs.limit(0)).count() == 0


def test_the_word_table_is_bounded(spark):
    docs = spark.range(300).selectExpr("id doc_id", "concat('1\n00:00:01,000 --> 00:00:02,000\nword', id, '. Next\n\n') text")
    assert S.corpus_stats(docs).counts.shape == (S.BUCKETS, S.KINDS)


SOUNDS = {
    "cut bracket": ["Come [What was that?", "noise] here.¶", "What [Music playing. Crowd", "cheers.] a mess!!¶"],
    "long and nested": ["Come [" + "Crowd cheers. " * 20 + "[noise] on.] here.¶"],
    "cut twice": ["Come (Music.", "More music.", "Silence.) here.¶"],
    "cut star and note": ["Come *Thunder.", "Rain.* here.¶", "♪ Slow waltz.", "Fast waltz. ♪ Thank you.¶", "*wind* Not again.¶ *rain*"],
    "unmatched": ["Come [here.¶", "- No.¶\n- Why] not?¶", "♪♪ Come here.¶", "Wait.¶ ♪"],
    "quotation over many cues": ["He said “Wait.", "No.", "Stop.", "Go.", "Run.” and left.¶"],
    "quotation opened anew": ["“Wait.¶", "No.¶", "He said “Go.” and left.¶"],
}


@pytest.mark.parametrize("name", SOUNDS)
def test_sounds_and_quotations_over_cues(name):
    text, want = expect(cues(*SOUNDS[name]))
    got = S.sentence_ends(text)
    assert got == want, [text[max(0, k - 12) : k + 1] for k in got]


def test_casing_is_judged_where_a_text_stands():
    loud, small = ["NOBODY LEFT THE OLD GATE OPEN.¶"] * 300, ["komm her...¶", "wer war am kanal?¶"] * 150
    usual = ["Wait for me...", "behind the mill.¶", "Nobody left the gate open.¶", "He came...", "and went.¶"] * 100
    border, low_border = ["Nobody left the gate open.¶"] * 30, ["komm her.¶"] * 30
    for parts in (loud + border + usual, usual + border + loud, small + low_border + border + usual, usual + border + low_border + small):
        text, want = expect(cues(*parts))
        assert S.sentence_ends(text) == want


EVIDENCE = {
    "a listed word that is none": ["Ils sont sept hommes.¶ Nous partons.¶", "Ils sont sept.¶ Nous partons.¶"],
    "a hesitation": ["Mm, okay.¶", "Mm.¶ Okay.¶"],
    "a letter": ["Who am I?¶", "So do I.¶ We left.¶", "Prof. J. I. Hill slept.¶"],
    "still abbreviations": ["Dr Hill slept.¶", "We met Dr.\nHill and Dr. Moss.¶"],
    "a long one": ["The Olymbrand. valley, and the Olymbrand. valley.¶", "The Olymbrand. Brannik fell.¶"],
    "a name": ["A rose grew.¶", "We saw Rose here.¶ The olym. valley.¶ The olym. Rose fell.¶"],
}


@pytest.mark.parametrize("name", EVIDENCE)
def test_document_evidence_comes_before_the_lists(name):
    text, want = expect(cues(*EVIDENCE[name]))
    got = S.sentence_ends(text)
    assert got == want, [text[max(0, k - 12) : k + 1] for k in got]


def test_words_that_share_a_bucket_keep_their_own_counts(spark):
    seen, k = {}, 0
    while (b := S._bucket(f"word{k}")) not in seen:
        seen[b] = f"word{k}"
        k += 1
    one, two = seen[b], f"word{k}"
    docs = spark.createDataFrame([(1, cues(f"We saw {one}.", "Yes.")), (2, cues(f"We saw {two}", "on.", f"We saw {two}", "on."))], "doc_id bigint, text string")
    stats = S.corpus_stats(docs)
    assert stats.get(one)[: S.OPEN + 1] == [1, 0] and stats.get(two)[: S.OPEN + 1] == [0, 2]
    assert stats.get("absent") == [0] * S.KINDS


def test_windows_follow_words_not_signs():
    long = "Olym" + "brand" * 12
    text, want = expect(cues(f"The {long}. valley, and the {long}. valley.¶", f"The {long}. Brannik fell.¶"))
    assert S.sentence_ends(text) == want
    far = "“Wait!” " + "Marwenna" * 12 + " shouted\nat the mill.¶"
    text, want = expect(cues("It is late.¶", far))
    assert S.sentence_ends(text) == want
    text, want = expect(cues("<font color='" + "x" * 120 + "'>Come. here.¶</font>".replace(". here", " here")))
    assert S.sentence_ends(text) == want


def test_a_title_that_closes_turns_is_none():
    text, want = expect(cues("- A rev.¶\n- The rev.¶", "- My rev.¶\n- Just one rev.¶ Then we go.¶"))
    assert S.sentence_ends(text) == want
    text, want = expect(cues("We met Rev. Hill and Rev.\nMoss.¶"))
    assert S.sentence_ends(text) == want


def test_names_by_the_corpus_where_the_document_is_silent(spark):
    near = [cues("The olym. valley,", "and the olym. hill.")] * 6
    names = [cues("We met", "Brannik there.")] * 3
    plain = [cues("We know", "nobody there.")] * 3
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(near + names + plain)], "doc_id bigint, text string")
    stats = S.corpus_stats(docs)
    for text in ("We saw the olym. Brannik fell.¶", "We saw the olym.¶ Nobody fell.¶"):
        text, want = expect(cues(text))
        assert S.sentence_ends(text, stats) == want


GOES_ON = {
    "dots after a blank": ["Also ... Brerond schlief im Aufzug.¶", "„Also ... Olnnavin\nhat es gesehen.“¶ Nein.¶"],
    "a quotation amid small letters": ["the sign reads \"keep out!\nwet paint.\" on the north pier.¶ no.¶"] * 3,
    "the form of a firm": ["Tolva y Cía. S. A. pintó la barca.¶", "¡Tolva y Cía. S.\nA. perdió la señal!¶ No.¶"],
    "a title and its name": ["Her brother moved to St.", "Orrin St. in the end.¶", "Ask Mr. Hill or Mrs.", "Skammoya.¶ No.¶"],
    "an abbreviation and its number": ["It is in fig. 3, vol.", "2, not here.¶", "Es war ca.", "5 Uhr.¶", "No.¶", "3 of them slept.¶"],
    "initials": ["We met Prof. J.", "R. Fendra there.¶ No.¶"],
    "firms and hours that end a cue": ["She works for Hill & Co.¶", "We left at 5 p.m.¶", "Come here.¶"],
    "an unmarked cue before a quotation": ["มานี่¶", "\"หยุด!\" โทลวาตะโกน¶", "ไม่¶"],
    "lost marks": ["Keep your voice down�¶", "There is a light.¶ � slow waltz �", "Nobody called about the �", "lamp in room four.¶"],
    "nothing between": ["Komm her.¶„Nein.“¶", "What a mess.¶“Did he ask you.”¶", "It was late.¶Sgt. Hill slept.¶"],
    "a capital after a full stop in quotation": ["“They say he left years ago.”¶ So the clerk asked for a spoon.¶", "“Stop!” Hill shouted.¶"],
    "small letters and a word alone": ["no.¶ creo que llueve.¶", "no.¶ ¡mi tía llegó!¶"] * 3,
    "quotations whose marks were lost": ["Tolva sagte: �Warte. Bleib da.� und schwieg.¶", "� Arr�tez tout ! � cria Quildo.¶ Non.¶", "Sie fl�stern.¶"],
    "their marks as questions": ["El afinador dijo: ?Espera. No te muevas.? y call? tambi?n.¶", "Est? aqu?.¶ ??Ven!?¶", "La se?al es as?.¶"],
    "a title before another speaker": ["- We saw the Rev.¶", "- Why?¶"],
}


@pytest.mark.parametrize("name", GOES_ON)
def test_what_goes_on_over_a_stop(name):
    text, want = expect(cues(*GOES_ON[name]))
    got = S.sentence_ends(text)
    assert got == want, [text[max(0, k - 12) : k + 1] for k in got]


def _calls(f):
    """Calls of functions of Python and C while f runs."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        f()
    finally:
        sys.setprofile(None)
    return n


def test_calls_a_sentence_are_few():
    lines = ["It is late.¶ Who fed\nthe herons?¶", "Prof. Hill left at 10:45 a.m. every day.¶", "Mukaux dit : « Attends. » et\na raté le signal.¶", "Keep your voice", "down...¶", "Come here!¶"]
    text, want = expect(cues(*lines * 40))
    ends = []
    S.sentence_ends(text)  # what is kept between documents is there
    assert _calls(lambda: ends.extend(S.sentence_ends(text))) < 75 * len(want)
    assert ends == want
    seen = [[] for _ in range(S.KINDS)]
    assert _calls(lambda: S.gather_words(text, seen)) < 28 * len(lines) * 40


def _plain_cues(text):
    """Texts of cues, line by line: a timing line begins one, and a number line before it belongs to it."""
    bodies = [[]]
    for line in text.split("\n"):
        if "->" in line and ":" in line and line.lstrip("﻿ \t")[:1].isdigit():
            if bodies[-1] and bodies[-1][-1].strip("﻿�? \t\r").isdigit():
                bodies[-1].pop()
            bodies.append([])
        else:
            bodies[-1].append(line)
    return ["\n".join(b).strip() for b in bodies]


ODD_CUES = [
    cues("It is late.", "42", "No."),
    cues("It is late.", "No.").replace("\n", "\r\n"),
    cues("An arrow -> here.", "Two: 3 -> 4", "5: 6 -> 7", "No."),
    "﻿" + cues("First.", "Second."),
    "00:00:01,000 --> 00:00:02,000\nNo number.\n00:00:03,000 --> 00:00:04,000\nNor here.\n\n?3\n 00:00:05,000 --> 00:00:06,000 X1:5 -> 6\nYes.",
    "1\n00:00:01,000 --> 00:00:02,000\n2\n00:00:03,000 --> 00:00:04,000\n\n²\n00:00:05,000 --> 00:00:06,000",
    "1\n00 -> 00:01\nA\n\n٣\n٠:٠ -> ٠:١\nB\n7\n\n8\nC",
    "",
]


@pytest.mark.parametrize("k", range(len(ODD_CUES)))
def test_cues_are_those_of_a_reading_by_lines(k):
    text = ODD_CUES[k]
    assert [text[a:b].strip() for a, b in S.cue_spans(text)] == _plain_cues(text)
    assert [b.strip() for b in S._cue_bodies(text)] == _plain_cues(text)
