import numpy as np
import pyarrow as pa
import pytest

from stelae.llm import text_quality as q

NAMES = [n for n, _, _ in q.FIELDS]


def measured(*texts, common=frozenset()):
    columns = q.measure(pa.array(list(texts), pa.string()), common)
    return [dict(zip(NAMES, values)) for values in zip(*columns)]


def cues(lines):
    return "".join(f"{n}\n00:00:{n:02},000 --> 00:00:{n:02},900\n{line}\n\n" for n, line in enumerate(lines, 1))


SPEECH = ["She never told me about it.", "- What do you want?", "[wind howling]", "♪ slow piano ♪", "I could not find the key", "to the house before the storm."]
CASES = {
    "prose": cues(SPEECH * 3), "shouted": cues([s.upper() for s in SPEECH] * 2), "japanese": cues(["彼は本当は、家に帰りたかったんだ。", "待って。"] * 4),
    "decoded": cues([s.encode().decode("cp1252", "replace") for s in ["Il a eu peur de la forêt.", "Ça suffit.", "Elle était à côté de la rivière gelée"]] * 4),
    "russian": cues([s.encode("cp1251").decode("cp1252") for s in ["Сосед уже не помнит письмо без слов.", "Он и не ждал правду"]] * 4),
}
STRUCTURE = {
    "table": cues(["| 1 | seam | 34 |", "| 2 | arch | 56 |"] * 5), "tabs": "Sefi\t8\t80.9%\tno\nTobin\t40\t5.3%\tyes\n" * 4,
    "csv": cues(["2,linen,58,,0", "3,talc,15,,1"] * 5), "numbered": cues([f"{n}) marginal hinge" for n in range(12)]),
    "names": cues(["Zell / Bruna / Ragna", "Juno, Tenko, Ilsa"] * 5), "symbols": cues(["}$$^~$/&§°$", "_#@*^°>§¬#"] * 5),
    "hex": cues([f"{n:08x}  a4 8b 79 2a" for n in range(10)]), "random": cues(["jrnjjtk dadjjss bscf wfadp.", "awamk scskkakfl ekziyt"] * 5),
    "pairs": cues(["torque - cork", "CADENCE", "hinge = mica"] * 4), "credits": cues(["Titles ....... Wim S.", "Foley ........ Juno"] * 5),
    "glossary": cues(["the house - la maison", "my brother - mon frère", "to be or not - être ou non"] * 4),
    "repeated": cues(["xx xx xx xx xx"] * 8), "fields": cues(["reel=2 fps=25 drop=4", "reel=7 fps=30 drop=39"] * 5),
}


@pytest.mark.parametrize("name", CASES)
def test_speech_is_prose(name):
    assert measured(CASES[name])[0]["body"] == "prose"


@pytest.mark.parametrize("name", STRUCTURE)
def test_structure_is_no_prose(name):
    body = measured(STRUCTURE[name])[0]["body"]
    assert body in ("list", "table", "junk")
    assert name not in ("table", "tabs", "csv") or body == "table"


def test_figures():
    got = measured("1\n00:00:01,000 --> 00:00:02,000\nI am the cat.\nbig dog\n", common=frozenset({"i", "am", "the"}))[0]
    assert (got["lines"], got["words"]) == (2, 6)
    assert got["mean_word_length"] == pytest.approx((1 + 2 + 3 + 3 + 3 + 3) / 6)
    assert got["punctuated_lines"] == 0.5 and got["symbol_ratio"] == pytest.approx(1 / 16)
    assert got["common_words"] == pytest.approx(3 / 6)


def test_alignment_and_rhythm():
    table, prose = measured(STRUCTURE["table"], CASES["prose"])
    assert table["alignment"] == 1.0 > prose["alignment"]
    assert measured(cues(["Chapter 1", "Elastic Membrane"] * 8))[0]["length_autocorrelation"] > 0.9


def test_empty_blank_and_mixed_blocks():
    got = measured("", " \n\t\r\n", "﻿", "1\n00:00:01,000 --> 00:00:02,000\n", CASES["prose"], "", STRUCTURE["csv"])
    assert [r["body"] for r in got] == ["empty"] * 4 + ["prose", "empty", "table"]
    assert got[0]["words"] == 0 and got[0]["symbol_ratio"] == 0.0
    alone = measured(CASES["prose"])[0]
    assert got[4] == alone  # neighbours in a block do not matter


def test_half_structure_is_prose_and_line_ends_do_not_matter():
    half = [*SPEECH[:2], "I took the last train and that is all.", "| 1 | seam | 3 |", "| 2 | arch | 4 |", "| 3 | keel | 5 |"]
    assert measured(cues(half))[0]["body"] == "prose"
    unix = measured(CASES["prose"])[0]
    assert measured(CASES["prose"].replace("\n", "\r\n"))[0] == unix == measured(CASES["prose"].replace("\n", "\r"))[0]


def test_table(spark, rows):
    data = [(1, CASES["prose"], "x"), (2, STRUCTURE["csv"], "x"), (2, STRUCTURE["csv"], "x"), (None, STRUCTURE["hex"], "x"), (4, None, "x"), (5, "the " * 300_000, "x"), (6, " ".join(SPEECH[:2]) * 30_000, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, lines string")
    found = q.not_prose(q.statistics(df, "doc_id", "text")).select("doc_id")
    assert rows(found) == [(2,), (2,), (5,), (None,)]  # one word over and over is junk
    assert q.statistics(df, "doc_id", "text").count() == 7
    assert q.statistics(df.limit(0), "doc_id", "text").count() == 0


ITEMS = [("Bread", "from the oven in the yard"), ("Beans", "with the salt of my house"), ("Broth", "for all who were not here"), ("Berry", "in the jar on the bottom")]


def test_layout_alone_makes_a_list_of_common_words():
    laid_out = "".join(f"The {a}\n    {b}\n" for a, b in ITEMS * 2)
    flat = laid_out.replace("    ", "")
    got, without = measured(laid_out, flat)
    assert got["body"] == "list" and got["alignment"] == 0 and got["indent_period"] >= 0.7
    assert without["body"] == "prose" and without["indent_period"] == 0 < without["length_autocorrelation"]


def test_indented_speech_songs_and_sounds_stay_prose():
    hanging = "".join(f"{s}\n  {t}\n" for s, t in zip(SPEECH * 2, reversed(SPEECH * 2)))
    song = "".join(f"♪ The {a} ♪\n    ♪ {b} ♪\n" for a, b in ITEMS * 2)
    block = "".join(f"    {s}\n" for s in SPEECH * 3)
    sounds = cues(["(wind howling)", "   (a door)"] * 5)
    assert [r["body"] for r in measured(hanging, song, block, sounds)] == ["prose"] * 4


# Dialogue of languages that nothing in the module lists.
DIALOGUE = {
    "italian": ["Non so dove sia andato tuo fratello.", "Aspetta, vengo con te", "Hai chiuso la porta?", "Non mi ha detto niente della casa", "e poi è sparito."],
    "portuguese": ["Não sei o que aconteceu ontem.", "Você viu a minha irmã?", "Ela saiu cedo de casa", "e ninguém a viu desde então.", "Vamos embora!"],
    "polish": ["Nie wiem, gdzie on mieszka.", "Chrząszcz brzmi w trzcinie", "Dlaczego wszyscy milczą?", "Wrócę jutro rano,", "jeśli przestanie padać."],
    "turkish": ["Kardeşimin nerede olduğunu bilmiyorum.", "Kapıyı neden kapattın?", "Dün akşam eve geç geldi", "ve kimseyle konuşmadı.", "Gidelim artık."],
    "chinese": ["我不知道他去哪儿了。", "你为什么不告诉我？", "昨天晚上他很晚才回家", "也没有跟任何人说话", "我们走吧！"],
    "hindi": ["मुझे नहीं पता वह कहाँ गया।", "तुमने दरवाज़ा क्यों बंद किया?", "कल रात वह देर से घर आया", "और किसी से बात नहीं की।", "चलो चलते हैं!"],
    "finnish": ["En tiedä, minne hän meni.", "Miksi suljit oven?", "Hän tuli eilen myöhään kotiin", "eikä puhunut kenellekään.", "Mennään jo!"],
    "arabic": ["لا أعرف أين ذهب أخوك.", "لماذا أغلقت الباب؟", "عاد إلى البيت متأخرا ليلة أمس", "ولم يتحدث مع أحد.", "هيا بنا!"],
    "greek": ["Δεν ξέρω πού πήγε.", "Γιατί έκλεισες την πόρτα;", "Χθες το βράδυ γύρισε αργά", "και δεν μίλησε με κανέναν.", "Πάμε!"],
}


@pytest.mark.parametrize("language", DIALOGUE)
def test_dialogue_of_any_language_is_prose(language):
    lines = DIALOGUE[language]
    assert measured(cues(lines * 3))[0]["body"] == "prose"
    assert measured(cues(["- " + s for s in lines] * 3))[0]["body"] == "prose"


def test_lists_of_any_language_are_lists():
    assert measured(cues([f"{n}. capitolo nuovo" for n in range(9)]))[0]["body"] == "list"
    assert measured(cues(["pane, vino, olio, sale", "mele, pere, uva", "riso, farina, burro, latte"] * 3))[0]["body"] in ("list", "table")


CHAPTERS = cues(["Part", "Elastic Marginal Membrane"] * 8)


def test_every_kind_of_layout_decides(monkeypatch):
    """Without autocorrelation, or without alignment, verdicts change."""
    laid_out = "".join(f"The {a}\n    {b}\n" for a, b in ITEMS * 2)
    bars = cues(["| 1 | seam | 34 |", "| 2 | arch | 56 |"] * 5)
    fields = cues(["reel one = of the house", "reel two = in the yard", "so far = with my salt"] * 4)
    texts = [CHAPTERS, laid_out, bars, fields]
    assert all(r["body"] != "prose" for r in measured(*texts))
    monkeypatch.setattr(q, "_autocorrelation", lambda values, group, groups, **_: np.zeros(groups))
    assert [r["body"] == "prose" for r in measured(*texts)] == [True, True, False, False]
    monkeypatch.undo()
    monkeypatch.setattr(q, "_recurring", lambda text, delimiter, counted, groups: np.zeros((groups, q.DELIMITERS + 1)))
    assert [r["body"] == "prose" for r in measured(*texts)] == [False, False, True, False]


def test_common_words_are_those_of_the_table(spark, rows):
    data = [(1, cues(["La casa e la porta", "e poi la strada"])), (2, cues(["la porta e il cane"])), (3, None), (4, ""), (5, cues(["E la nave va"]))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(q.common_words(df, "text", 2)) == [("e", 3), ("la", 3)]
    got = {r.doc_id: r.common_words for r in q.statistics(df, "doc_id", "text", 2).collect()}
    assert got == {1: pytest.approx(5 / 9), 2: pytest.approx(2 / 5), 3: 0.0, 4: 0.0, 5: pytest.approx(2 / 4)}
    assert q.common_words(df.limit(0), "text").count() == 0
