"""Section trees and chunk rows on literal statutes, and what must hold for all documents."""

import hashlib
import random

import pytest

from lodestone.operators import sections
from lodestone.operators.sections import Grammar

#: Statutes in the wording of the corpus that the operators are made for.
LAW = Grammar(article=r"(?i)^(?:#{1,6}\s*)?(\d+(?:\.\d+)*)\s*(?:дүгээр|дугаар)\s+зүйл\.?\s*(.*)$", chapter=r"(?i)^(?:\w+\s+)?(?:бүлэг|дэд бүлэг|хэсэг)\b.*$", reference=r"(?i)\b\d+(?:\.\d+)*\s*(?:дугаар|дүгээр)?\s*(?:зүйл|заалт)\b", amendment="(?i)(?:нэмэлт|өөрчлөлт|хүчингүй)")
PLAIN = Grammar(article=r"^Article ([0-9]+)\.\s*(.*)$", chapter=r"^CHAPTER ")

CLAUSES = "\n".join([
    "25 дугаар зүйл. Хүүхэдтэй харилцах эрх", "25.1. Эцэг эх тусдаа амьдарч байгаа бол хүүхэдтэйгээ харилцах эрхээ хэрэгжүүлнэ.",
    "25.2. Хүүхдийн ашиг сонирхолд харшлахгүй нөхцөлөөр уулзах, холбоо барих боломжийг хангана.", "25.3. Маргаан гарвал шүүх болон эрх бүхий байгууллагаар шийдвэрлүүлж болно.",
])
LABELS = "\n".join([
    "43 дугаар зүйл. Ажилтны эрх", "43.1 Ажилтан дараах эрхтэй:", "а/ аюулгүй, эрүүл ахуйн шаардлага хангасан ажлын байранд ажиллах;", "б/ хөдөлмөрийн үр дүнд тохирсон цалин хөлс авах;",
    "43.2 Ажилтан дараах үүрэгтэй:", "а/ хөдөлмөрийн дотоод журам сахих;", "б/ ажил олгогчийн хууль ёсны шаардлагыг биелүүлэх.",
])


def test_a_tree_has_parents_and_paths():
    text = "Preamble line\nCHAPTER ONE\nArticle 1. First\n1.1 a clause\na) part\nb) part\n2.1 no clause of this article\nCHAPTER TWO\nArticle 2. Second\n2.1. its clause\nlast line"
    nodes = sections.section_tree(text, PLAIN)
    assert [(n.kind, n.no, n.parent, n.chapter) for n in nodes] == [
        ("preamble", "preamble", -1, ""), ("chapter", "", -1, "CHAPTER ONE"), ("article", "1", -1, "CHAPTER ONE"), ("clause", "1.1", 2, "CHAPTER ONE"), ("subclause", "1.1.a", 3, "CHAPTER ONE"), ("subclause", "1.1.b", 3, "CHAPTER ONE"),
        ("chapter", "", -1, "CHAPTER TWO"), ("article", "2", -1, "CHAPTER TWO"), ("clause", "2.1", 7, "CHAPTER TWO"),
    ]
    assert nodes[5].path == ("CHAPTER ONE", "Article 1. First", "1.1", "b") and text[nodes[5].start : nodes[5].end] == "b) part\n2.1 no clause of this article\nCHAPTER TWO"
    assert text[nodes[8].start : nodes[8].end] == "2.1. its clause\nlast line" and text[nodes[0].start : nodes[0].end] == "Preamble line\nCHAPTER ONE"
    assert sections.section_tree("", PLAIN)[0].kind == "preamble"


def test_articles_are_cut_at_three_clauses():
    found = sections.pieces(CLAUSES, LAW, small=0)
    assert [(p.kind, p.article_no, p.clause_no) for p in found] == [("clause", "25", f"25.{i}") for i in (1, 2, 3)]
    assert all(p.text.startswith("25 дугаар зүйл. Хүүхэдтэй харилцах эрх\n25.") and p.path.endswith(p.clause_no) and p.article_title == "Хүүхэдтэй харилцах эрх" for p in found)
    assert [p.kind for p in sections.pieces(CLAUSES.rsplit("\n", 1)[0], LAW)] == ["article"]  # two clauses, not long


def test_clauses_are_cut_at_their_labels():
    found = sections.pieces(LABELS, LAW, most=200, small=0)
    assert [(p.kind, p.clause_no, p.subclause_no) for p in found] == [("subclause", "43.1", "43.1.а"), ("subclause", "43.1", "43.1.б"), ("subclause", "43.2", "43.2.а"), ("subclause", "43.2", "43.2.б")]
    assert found[1].text == "43 дугаар зүйл. Ажилтны эрх\n43.1 Ажилтан дараах эрхтэй:\nб/ хөдөлмөрийн үр дүнд тохирсон цалин хөлс авах;"
    assert found[1].path == "43 дугаар зүйл. Ажилтны эрх > 43.1 > б"


def test_section_headings_are_in_the_rows(spark):
    text = "1 дүгээр зүйл\nЭнэ зүйл нь хууль хэрэгжүүлэх үндсэн зарчмыг тодорхойлно.\n\n2 дугаар зүйл\nЭнэ зүйл нь хэрэгжилтийн хяналт, тайлагналыг зохицуулна, 1 дүгээр зүйл."
    docs = spark.createDataFrame([(2, text, "Бүтэцтэй хууль"), (3, None, None), (4, "", "x")], "doc_id long, text string, title string")
    rows = sections.chunk_rows(docs, LAW, law="title").orderBy("chunk_index").collect()
    assert [(r["doc_id"], r["chunk_index"], r["article_no"], r["heading_path"]) for r in rows] == [(2, 0, "1", "1 дүгээр зүйл"), (2, 1, "2", "2 дугаар зүйл")]
    one = rows[1]
    assert one["text"].startswith("Law: Бүтэцтэй хууль\nArticle: 2\n\n2 дугаар зүйл\n") and one["references"] == ["2 дугаар зүйл", "1 дүгээр зүйл"]
    assert one["content_hash"] == hashlib.sha256(one["text"].encode()).hexdigest() and one["char_count"] == len(one["text"]) and one["token_count"] == len(one["text"].split())
    hashed = hashlib.sha256(f"2:1:{one['content_hash']}".encode()).hexdigest()
    assert len(one["chunk_id"]) == 36 and one["chunk_id"][:8] == hashed[:8] and one["chunk_id"][14] == "4"
    assert text[one["char_start"] : one["char_end"]].startswith("2 дугаар зүйл")


def test_repeated_paragraphs_get_places_of_their_own():
    same = "This paragraph stands in the text twice and is long enough to be a chunk of its own, as it says the same again. " * 2
    text = f"Article 1. One\n1.1 {same}\n1.2 {same}\n1.3 {same}\nArticle 2. Two\n{same}"
    found = sections.pieces(text, PLAIN, most=300, small=0)
    starts = [p.start for p in found]
    assert starts == sorted(set(starts)) and len(found) >= 4
    assert all(same[:60] in text[p.start : p.end] for p in found if same[:60] in p.text)


def test_small_pieces_join_and_repeats_go():
    text = "Article 1. One\n1.1 short amended\n1.2 also Article 7\n1.3 and this\nArticle 2. Two that is long enough\nArticle 2. Two that is long enough"
    found = sections.pieces(text, PLAIN)
    assert [p.article_no for p in found] == ["1", "2"]  # the same article again is left out; its pieces were joined to it
    assert found[0].text.count("Article 1. One") == 3 and found[0].references == ["Article 7"] and found[0].amendments == ["1.1 short amended"]


def test_long_pieces_are_packed_in_one_scan():
    rnd = random.Random(11)
    for _ in range(60):
        text = " ".join("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))) + rnd.choice(["", "", ".", "!"]) for _ in range(rnd.randint(1, 300)))
        most, overlap = rnd.choice([(60, 12), (200, 40)])
        parts = list(sections.packed(text, 5, most, overlap))
        assert all(len(t) <= most and text[a - 5 : b - 5].strip() == t for t, a, b in parts)
        covered = set().union(*(range(a, b) for _, a, b in parts)) if parts else set()
        assert all(i + 5 in covered for i, c in enumerate(text) if c != " ")
        assert [a for _, a, _ in parts] == sorted(a for _, a, _ in parts)


@pytest.mark.parametrize("grammar", [PLAIN, LAW])
def test_all_of_a_text_is_in_its_pieces(spark, data, grammar):
    for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect():
        lines = [f"Article {i}. " + x if i % 4 == 0 else f"{i // 4 * 4}.{i % 4} " + x for i, x in enumerate(r["text"].split("\n"), 4)]
        text = "\n".join(lines)
        found = sections.pieces(text, grammar, small=0)
        starts = [p.start for p in found]
        assert starts == sorted(starts) and all(p.end <= len(text) for p in found)
