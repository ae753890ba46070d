import math
import random
from itertools import product

import pytest

from tidemark.llm import sentences
from tidemark.plans.tables import table

DATA_LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return sentences.train(sentences.gap_table(table(spark, DATA_LARGE, "documents")))


CASES = [
    "The kits are sold in Canada and the U.S.| The U.S. unit shipped approx. 1,852 kits vs. 140,370 a year earlier.| 2026 targets stay as they were.",
    "“The vote was close.| Was it fair?| We think so.”| Costs fell for the third time in a row (the first such run since the spin-off).",
    "“Nothing has changed!” the desk told the meeting.| \"Did the margin hold?\" asked the chair during the call.| Why now?",
    "The board considered a merger ... and then let the deadline pass.| (All amounts are unaudited.)| No further guidance was given!",
    "Trading in ZKA was halted at 5:29 a.m. and resumed at 8:20 a.m. after the notice went out.| Delivery starts on Nov. 12 at 8:20 p.m.| The plan covers 7 shares (see Sec. 15(b) of the deed).",
    "Am 12. März tritt z. B. die neue Satzung in Kraft.| Zum 31. Dezember lag der Streubesitz bei 2,7 %.| Weitere Angaben stehen im Anhang (s. S. 58 ff.).| „Reicht die Liquidität?“, fragte ein Aktionär.",
    "Die Zahlen gelten bis auf Weiteres für Werke, Lager usw.| Der Vorstand lehnte das Angebot ab!",
    "« Pourquoi attendre ? » demande un actionnaire.| L'offre sera-t-elle relevée ?| Le groupe compte env. 543 salariés, dont 40 p. 100 hors d'Europe.",
    "—¿Y la deuda? —preguntó un socio.| El Sr. Ostrake dejará el cargo el 3 de mayo, según el art. 34 del reglamento.| ¡El consejo rechazó la oferta!",
    "「工場は再開した。」|取引は午前6:23に停止され、午前5:34に再開された。|監査法人は「重要な問題はない。」との意見を出した。|新株の発行はあるのか？",
    "“我们不会增发新股。”财务负责人说。|管理层表示：“全年目标不变。”|停牌原因是什么？",
    "คณะกรรมการไม่อนุมัติการออกหุ้นเพิ่มทุน| การซื้อขายกลับมาเริ่มใหม่เวลา 11.54 น. ของวันเดียวกัน",
    "डॉ. वेलमार ने कहा कि योजना में कोई बदलाव नहीं है।| बोर्ड ने प्रस्ताव ठुकरा दिया!| लाभांश 55.82 रु. प्रति शेयर रहेगा।",
    "قال د. فلمار إن الخطة لم تتغير.| هل ستصدر الشركة أسهماً جديدة؟| سيكون التوزيع 27.42 للسهم الواحد.",
    "Отчёт опубликован 5 марта 2026 г.| Подробнее см. п. 59.2 приложения на стр. 37.| По данным отчёта, т. е. без учёта аудита, долг снизился.",
    "float is only 4,002,061 shares, do the math...| not selling a single share lol.| imo Cortera prints by Fri. or I'm out.",
    "Asked the chair during the call.|The plan covers 463,666 shares.|A. V. Harrowes & Co. signed the report without remarks.|\"We will not issue new stock.\"|Why now?|Full terms are posted at https://ir.example.invalid/update/q52.v2.html for all holders.",
    "Management calls it \"a one-off.\"|Costs fell by 4.5%.|2026 targets stay as they were.|The U.S. unit closed at 5 p.m.| The plan covers 7 shares, e.g. those in Ver.2.1 of the deed.",
    "قال د. فلمار إن الخطة لم تتغير.|هل ستصدر الشركة أسهماً جديدة؟|बोर्ड ने प्रस्ताव ठुकरा दिया!|लाभांश 55.82 रु. प्रति शेयर रहेगा।",
    "A heading without mark\n\n|The plan is\nfinal.",
]


@pytest.fixture(scope="module")
def split(spark, model):
    df = spark.createDataFrame([(i, c.replace("|", "")) for i, c in enumerate(CASES)], "doc_id long, text string")
    got = {}
    for d, s, e in sorted(sentences.sentence_units(df, model).collect()):
        got.setdefault(d, []).append(CASES[d].replace("|", "")[s:e])
    return got


@pytest.mark.parametrize("i", range(len(CASES)), ids=lambda i: CASES[i][:18])
def test_known_boundaries(split, i):
    assert split[i] == [p.strip() for p in CASES[i].split("|")]


def test_an_event_may_hide_where_no_mark_is(spark):
    """Words that only ever begin paragraphs, behind words that only ever end them."""
    text = "\n\n".join(["Alpha did run far", "Beta was not there again", "they saw it"] * 400)
    df = spark.createDataFrame([(1, text), (2, "Alpha did run far Beta was not there again")], "doc_id long, text string")
    got = sorted((s, e) for d, s, e in sentences.sentence_units(df).collect() if d == 2)
    assert got == [(0, 17), (18, 42)]


def test_posteriors_against_all_paths():
    rng = random.Random(2)
    for _ in range(30):
        n = rng.randrange(1, 8)
        score, pair = [rng.uniform(-3, 3) for _ in range(n)], [rng.choice([0.0, -2.0]) for _ in range(n)]
        total, event = 0.0, [0.0] * n
        for path in product((0, 1), repeat=n):
            w = math.exp(sum(score[i] + (pair[i] if i == 0 or path[i - 1] else 0) for i in range(n) if path[i]))
            total += w
            event = [x + w * y for x, y in zip(event, path)]
        assert all(abs(x / total - y) < 1e-9 for x, y in zip(event, sentences.posteriors(score, pair)))


def test_every_character_once_on_the_whole_table(spark, data):
    docs = table(spark, data, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    spans = {}
    for d, s, e in sentences.sentence_units(docs).collect():
        spans.setdefault(d, []).append((s, e))
    for d, t in texts.items():
        at = -1
        for s, e in sorted(spans.get(d, [])):
            assert s >= at and e > s and not t[s].isspace() and not t[e - 1].isspace()
            assert not t[max(at, 0) : s].strip()
            assert "\n\n" not in t[s:e]
            at = e
        assert not t[max(at, 0) :].strip()


def test_nulls_blanks_long_texts_and_empty_tables(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n\n\t "), (4, "One two. Three four! " * 20_000), (None, "x.")], "doc_id long, text string")
    got = sentences.sentence_units(df, model).collect()
    assert {r["doc_id"] for r in got} == {4} and len(got) == 40_000
    assert sentences.sentence_units(df.limit(0)).collect() == []
