"""Markup, modules in SQLite, volumes in XML, tagged texts and lemma numbers."""

import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from glossa.operators import lemmas
from glossa.sources import library, markup, modules, tagged, volumes

NAMES = ["Gen"] * 9 + ["2 Sm"] + ["x"] * 8 + ["Ps"]
VERSE = (
    '<TS><span class="green"><em>A title</em><Ts> <CM>First words'
    '<RF q=[1]><em>words</em>, דָּבָר (<span class="tl">dawar</span>), cf. '
    "<a href='b1.1.27'>Gen 1:27</a>.<Rf> second words of it."
    "<RF q=ⓐ><a href='b19.8.3'>Ps 8:3</a>; <a href='b10.15.13-b10.17.22'>2Sm 15:13-17:22</a><Rf>"
)


def test_verses_give_text_display_and_notes():
    text, shown, notes = markup.read_verse(VERSE, NAMES, "/ref/")
    assert text == "First words second words of it."
    assert shown.startswith('<span class="pericope">A title</span>First words<sup class="fn">1</sup> second') and shown.endswith('<sup class="xr">ⓐ</sup>')
    assert [n[:2] for n in notes] == [("note", "1"), ("xref", "ⓐ")]
    assert '<i class="tl">dawar</i>' in notes[0][2] and 'href="/ref/?q=Gen+1%2C27"' in notes[0][2]
    assert notes[1][3] == "Ps 8:3; 2Sm 15:13-17:22" and "2+Sm+15%2C13-17%2C22" in notes[1][2]


@pytest.mark.parametrize(
    ("raw", "text", "shown"),
    [
        ("<CM><PI0><PF1>First line,<PI0><PF1>second <FI>added<Fi> <FR>his words<Fr>", "First line, second added his words", 'First line,<br>second <i>added</i> <span class="jesus">his words</span>'),
        ("a<RF>open note", "aopen note", "aopen note"),
        ("x &amp; y &lt;z <q>", "x & y <z", "x &amp; y &lt;z"),
        ("<h>Head</h>t", "t", '<span class="pericope">Head</span>t'),
        ("a  b\n c<br>d<br/>e", "a b c d e", "a b c<br>d<br>e"),
        ("1 < 2 <b>x", "1 < 2 x", "1 &lt; 2 <b>x</b>"),
        ("", "", ""), (None, "", ""),
    ],
)
def test_verse_details(raw, text, shown):
    assert markup.read_verse(raw)[:2] == (text, shown)


def test_unknown_elements_leave_their_text():
    shown, said = markup.sanitize('<script>alert(1)</script><img src=x onerror=y><a href="javascript:x">z</a><div style=\'x\'>text</div><b>ok</b>')
    assert shown == "alert(1)ztext<b>ok</b>" and said == "alert(1)ztextok"


def test_nesting_takes_linear_time():
    n = 100_000
    shown, said = markup.sanitize("<b>" * n + "x")
    assert shown == "<b>" * n + "x" + "</b>" * n and said == "x"
    assert markup.read_verse("<h>" * n + "t")[0] == "t"
    assert markup.sanitize("</b>" * n + "<" * n)[1] == "<" * n


def test_whatever_comes_out_is_balanced_and_allowed():
    rng = random.Random(3)
    bits = ["<b>", "</b>", "<i>", "</em>", "<em>", "<RF q=[2]>", "<Rf>", "<TS>", "<Ts>", "<FR>", "<Fr>", "text ", "&lt;", "<", ">", "<script x='<'>", "<a href='b1.2.3'>", "</a>", "<PI1>", "<CM>", "<br>", "<!-- c -->"]
    for _ in range(500):
        raw = "".join(rng.choices(bits, k=rng.randrange(0, 25)))
        _, shown, notes = markup.read_verse(raw, NAMES, "/r")
        for out in (shown, *(n[2] for n in notes)):
            open_ = []
            for close, tag in re.findall(r"<(/?)([a-z]+)[^<>]*>", out):
                if tag == "br":
                    continue
                assert tag in ("b", "i", "em", "a", "span", "sup")
                assert not close or open_.pop() == tag, (raw, out)
                open_ += [] if close else [tag]
            assert not open_, (raw, out)


def test_links_of_modules():
    names = ["x"] * 18 + ["Ps"]
    assert markup.module_link("b19.104.2-32", names) == "Ps 104,2-32"
    assert markup.module_link("b99.1.1", names) == markup.module_link("x", names) == markup.module_link("b0.1.1", names) == ""


def test_definitions():
    raw = "<b>ἁρπαγμός</b>, οῦ, ὁ<BR /> (ἁρπάζω); <BR />__1. robbery, <ref='Php.2.6'>Php.2:6</ref>, AV &amp; more <span>x</span>"
    assert markup.read_definition(raw) == "<b>ἁρπαγμός</b>, οῦ, ὁ\n(ἁρπάζω);\n1. robbery, [[Php.2.6|Php.2:6]], AV & more x"
    assert markup.read_definition(": beginning<br>1) first") == "beginning\n1) first"
    assert markup.read_meaning("1) father of one<br>2) of <i>God</i> &amp; all; ") == "1) father of one; 2) of God & all"
    assert markup.read_meaning("x" * 700) == "x" * 600 and markup.read_definition(None) == ""


def test_columns_of_markup(spark):
    df = spark.createDataFrame([("<b>a<q> &amp; b",), (None,)], "t string")
    got = [tuple(r) for r in df.select(markup.sanitized("t"), markup.plain("t"), markup.definition("t"), markup.meaning("t")).collect()]
    assert got == [("<b>a &amp; b</b>", "a & b", "<b>a & b", "a & b"), (None,) * 4]


def module(path, rows):
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE Bible (Book INTEGER, Chapter INT, Verse INTEGER, Scripture TEXT, Weight REAL)")
    con.executemany("INSERT INTO Bible (Book, Chapter, Verse, Scripture) VALUES (?, ?, ?, ?)", rows)
    con.execute("CREATE TABLE Empty (a TEXT)")
    con.commit()
    con.close()


def test_a_module_from_file_to_verses(spark, tmp_path):
    rows = [(1, 1, 1, VERSE), (10, 2, 6, "<CM>A verse,<RF q=[3]>remark<Rf>"), (10, 3, 1, "<CM>One."), (10, 3, 3, "<CM>Three."), (10, 3, None, "<CM>No number."), (10, 3, None, "<CM>Three.<RF q=[9]>x<Rf>"), (10, 4, 1, "<TS>only<Ts>")]
    module(tmp_path / "a.sqlite", rows + [(2, c, v, f"v {c} {v}") for c in range(1, 40) for v in range(1, 30)])
    spark.dataSource.register(modules.SqliteSource)
    read = spark.read.format("sqlite_rows").option("table", "Bible").option("parts", 7).load(str(tmp_path / "a.sqlite"))
    assert read.dtypes == [("Book", "bigint"), ("Chapter", "bigint"), ("Verse", "bigint"), ("Scripture", "string"), ("Weight", "double")]
    assert read.count() == len(rows) + 39 * 29 and read.rdd.getNumPartitions() == 7
    numbered = library.numbered(read.select(F.col("Book").alias("book"), F.col("Chapter").alias("chapter"), F.col("Verse").alias("verse"), F.col("Scripture").alias("text")))
    assert {(r.verse, r.text) for r in numbered.filter("book = 10 AND chapter = 3").collect()} == {(1, "<CM>One."), (2, "<CM>No number."), (3, "<CM>Three.")}
    found = markup.module_verses(numbered.withColumnRenamed("text", "scripture"), NAMES, "/r")
    texts = {(r.book, r.chapter, r.verse): (r.text, [n.label for n in r.notes]) for r in found.collect()}
    assert texts[1, 1, 1] == ("First words second words of it.", ["1", "ⓐ"]) and texts[10, 2, 6] == ("A verse,", ["3"])
    assert (10, 4, 1) not in texts and len(texts) == 5 + 39 * 29


def test_odd_modules(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "b.sqlite")
    con.execute('CREATE TABLE "odd ""name" (n INTEGER, t TEXT, b BLOB)')
    con.executemany('INSERT INTO "odd ""name" VALUES (?, ?, ?)', [(1, "x", b"raw"), ("not a number", 5, None), (None, None, b"\xff")])
    con.execute("CREATE TABLE none (a TEXT)")
    con.commit()
    con.close()
    spark.dataSource.register(modules.SqliteSource)
    read = spark.read.format("sqlite_rows").option("table", 'odd "name').load(str(tmp_path / "b.sqlite"))
    assert [tuple(r) for r in read.orderBy("t").collect()] == [(None, None, "�"), (None, "5", None), (1, "x", "raw")]
    assert spark.read.format("sqlite_rows").option("table", "none").load(str(tmp_path / "b.sqlite")).count() == 0
    with pytest.raises(Exception, match="no table"):
        spark.read.format("sqlite_rows").option("table", "missing").load(str(tmp_path / "b.sqlite"))


ORDERS = {volumes.key(k): v for k, v in {"Gen": 1, "Isa": 29, "Rom": 52, "Matt": 47, "1Cor": 53, "1 Cor": 53, "Ps": 23, "Ecclus": 28}.items()}
VOLUME = """<?xml version="1.0" encoding="UTF-8"?>
<ThML><ThML.head><title>Volume</title></ThML.head><ThML.body>
<div1 title="Title Page"><p>Some long front matter that is not to be read as a passage of anything.</p></div1>
<div1 title="IREN&#198;US"><p>Loose text before the works of this author, which belongs to none of them.</p>
  <div2 title="Preface"><p>The preface of this author is left out as well, long as it may be here.</p></div2>
  <div2 title="Against Heresies"><div3 title="Book III"><div3 title="Chapter XXI">
      <pb n="451"/>
      <p>God, then, was made man, and the Lord did save us <scripRef passage="Isa. vii. 14" osisRef="Bible:Isa.7.14">Isa. vii. 14</scripRef>. But not as<note place="foot"><p>Footnote to skip; <scripRef passage="Rom. v. 12" parsed="|Rom|5|12|5|12|">Rom. v. 12</scripRef>.</p></note>, some say.</p>
      <p>For let us make man <scripRef osisRef="Bible:Gen.1.26-Gen.1.27">Gen. i. 26</scripRef> says the <i>Word <b>to</b></i> the Son <pb n="452"/> and the Spirit of all.</p>
      <p>Second page paragraph, <scripRef osisRef="Bible:Matt.1">Matt. i</scripRef>, and <scripRef passage="1 Cor. xv. 3" parsed="|1Cor|15|3|15|3|">1 Cor. xv. 3</scripRef> plus <scripRef passage="Ps. cx. 1">Ps. cx. 1</scripRef>.</p>
      <table><p>A table's paragraph is no child of a division, so it is not read at all.</p></table>
  </div3></div3></div2>
</div1>
<div1 title="A Plain Work"><p>The first paragraph of a plain work, long enough to stay.</p><div2 title="Part"><p>short</p><p>And a second one within the part of the plain work, long enough too.</p></div2><p>Closing words of the plain work, again of a sufficient length.</p></div1>
</ThML.body></ThML>"""


def test_volumes():
    works = volumes.read_volume(VOLUME.encode(), ORDERS, "Someone", 150)
    assert [(w.author, w.title) for w in works] == [("Irenaeus", "Against Heresies"), ("Someone", "A Plain Work")]
    one, two = works[0].passages
    assert one[0] == two[0] == "Book III / Chapter XXI" and one[1] == "451" and two[1] == "452"
    assert one[2].startswith("God, then") and "Footnote" not in one[2] and "says the Word to the Son and the Spirit of all." in one[2]
    assert one[3] == [(29_007_014,) * 2, (52_005_012,) * 2, (1_001_026, 1_001_027)]
    assert two[3] == [(47_001_001, 47_001_999), (53_015_003,) * 2, (23_110_001,) * 2]
    assert [(p[0], p[2][:9]) for p in works[1].passages] == [("", "The first"), ("Part", "short And"), ("", "Closing w")]


def test_a_deep_volume_takes_linear_time():
    deep = "<div1 title='Work'>" + "<div2 title='t'>" * 3_000 + "<p>" + "<i>" * 3_000 + "A paragraph deep within, with enough letters to count." + "</i>" * 3_000 + "</p>" + "</div2>" * 3_000 + "</div1>"
    (work,) = volumes.read_volume(f"<ThML><ThML.body>{deep}</ThML.body></ThML>".encode(), {})
    assert work.passages[0][2].startswith("A paragraph deep") and work.passages[0][0].count(" / ") == 2_999
    (plain,) = volumes.read_volume(b"<root><div title='No body'><p>A root without a body counts as one, with long text.</p></div></root>", {})
    assert plain.title == "No body"


@pytest.mark.parametrize(
    ("how", "text", "wanted"),
    [
        ("by_id", "Bible:Gen.1.26", (1_001_026, 1_001_026)), ("by_id", "Gen.1.26-Gen.1.27", (1_001_026, 1_001_027)), ("by_id", "Bible:Gen.1.26-2.3", (1_001_026, 1_002_003)),
        ("by_id", "Gen.1.26-28", (1_001_026, 1_001_028)), ("by_id", "Bible:Matt.1", (47_001_001, 47_001_999)), ("by_id", "Bible:Foo.1.1", None), ("by_id", "", None), ("by_id", "Gen", None),
        ("by_parts", "|Gen|1|26|1|27|", (1_001_026, 1_001_027)), ("by_parts", "|Gen|1|26", (1_001_026, 1_001_026)), ("by_parts", "|Gen|x|26|", None), ("by_parts", "|Gen|2|1|1|1|", None),
        ("by_words", "Gen. i. 26-28", (1_001_026, 1_001_028)), ("by_words", "Matt. v", (47_005_001, 47_005_999)), ("by_words", "1 Cor. xv. 3", (53_015_003,) * 2),
        ("by_words", "Ecclus. xxiv. 5", (28_024_005,) * 2), ("by_words", "Josephus, Ant. ii. 3", None), ("by_words", "Gen. iv", (1_004_001, 1_004_999)), ("by_words", "", None),
    ],
)
def test_notations(how, text, wanted):
    assert getattr(volumes.Places(ORDERS), how)(text) == wanted


def test_volumes_as_rows(spark, tmp_path):
    (tmp_path / "a.xml").write_text(VOLUME, encoding="utf-8")
    got = volumes.read_volumes(spark, str(tmp_path / "*.xml"), ORDERS, most=150).orderBy("work", "ord").collect()
    assert [(r.work, r.ord, r.page) for r in got] == [(0, 0, "451"), (0, 1, "452"), (1, 0, ""), (1, 1, ""), (1, 2, "")]
    assert got[0].refs[2].end == 1_001_027


def psalm(chapter, verse):
    """The Hebrew number of a Greek psalm, case by case."""
    if chapter <= 8 or 148 <= chapter <= 150:
        return chapter, verse
    special = {9: lambda v: (9, v) if v <= 21 else (10, v - 21), 113: lambda v: (114, v) if v <= 8 else (115, v - 8), 114: lambda v: (116, v), 115: lambda v: (116, v + 9), 146: lambda v: (147, v), 147: lambda v: (147, v + 11)}
    return special[chapter](verse) if chapter in special else (chapter + 1, verse) if chapter < 148 else None


def test_renumbering(spark):
    verses = spark.createDataFrame([(23, c, v, i) for i, (c, v) in enumerate((c, v) for c in range(1, 153) for v in (1, 8, 9, 21, 22, 40))] + [(5, 151, 3, -1)], "order int, chapter int, verse int, at int")
    got = {r.at: (r.chapter, r.verse) for r in tagged.renumbered(verses, tagged.psalm_map(spark, 23)).collect()}
    for r in verses.collect():
        assert got.get(r.at) == ((151, 3) if r.at == -1 else psalm(r.chapter, r.verse))


def test_tagged_lines(spark, tmp_path):
    word = "ἀόρατος<S>701318</S><m>lxx.A.NSM</m><S>517</S><S>70518</S> ἀκατασκεύαστος<S>700529</S><m>lxx.A.NSM</m> <i>[/8]</i> καὶ<S>707031</S><m>lxx.C</m><S>72518</S><S>2532</S>"
    other = "λόγος<S>700001</S><m>lxx.N.NSM</m>"
    lines = [f"10\t1\t2\t{word}", f"230\t9\t22\t{other}", f"230\t10\t1\t{word}", f"315\t1\t3\t{other}", f"320\t6\t3\t{word}", f"315\t2\t1\t{other}", "230\t151\t1\tno words", f"230\t151\t1\t{other}", "broken", "10\tx\t1\ty", f"10\t1\t2\t{other}", "10\t1\t9\tplain"]
    (tmp_path / "t.csv").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "ids.csv").write_text("1\t701318\n2\t707031\n3\t701318\n4\n", encoding="utf-8")
    (tmp_path / "words.csv").write_text("1\tἀόρατος\n2\tκαί\n3\tother\n4\tx\n", encoding="utf-8")
    books = spark.createDataFrame([(10, 1, None), (230, 23, None), (315, 31, 6), (320, 31, None)], "book int, order int, chapter_is int")
    lexemes = tagged.lexeme_list(spark, str(tmp_path / "ids.csv"), str(tmp_path / "words.csv"))
    assert sorted(tuple(r) for r in lexemes.collect()) == [("701318", "ἀόρατος"), ("707031", "καί")]
    got = {(r.order, r.chapter, r.verse): r for r in tagged.tagged_verses(tagged.read_lines(spark, str(tmp_path / "t.csv")), books, tagged.psalm_map(spark, 23), lexemes).collect()}
    # Greek 9,22 is Hebrew 10,1 and Greek 10,1 is 11,1; the letter stands before the chapter of the same book; psalm 151 has no place
    assert sorted(got) == [(1, 1, 2), (23, 10, 1), (23, 11, 1), (31, 6, 3)]
    assert got[31, 6, 3].text == "λόγος" and got[1, 1, 2].text == "ἀόρατος ἀκατασκεύαστος καὶ" and got[1, 1, 2].ordinal == 1_001_002
    assert [tuple(t)[1:] for t in got[1, 1, 2].tokens] == [("ἀόρατος", "ἀόρατος", "G517", "A.NSM", "A"), ("ἀκατασκεύαστος", "", "", "A.NSM", "A"), ("καὶ", "καί", "G2532", "C", "C")]


LEXEMES = [
    ("G4459", "πῶς", "πωσ"), ("G4458", "πως", "πωσ"), ("G2590", "καρπός", "καρποσ"), ("G7804", "καρπός", "καρποσ"), ("G2591", "Κάρπος", "καρποσ"), ("G2669", "καταποντίζω", "καταποντιζω"),
    ("G3779", "οὕτως", "ουτωσ"), ("G3475", "Μωϋσῆς, Μωσῆς", "μωυσησ, μωσησ"), ("G1672", "Ἕλλην=Ἕλλην", "ελλην=ελλην"), ("G622", "ἀπολλύω", "απολλυω"), ("G3660", "ὄμνυμι", "ομνυμι"),
    ("G2097", "εὐαγγελίζομαι", "ευαγγελιζομαι"), ("G5552", "χρύσεος", "χρυσεοσ"), ("G5062", "τεσσαράκοντα", "τεσσαρακοντα"),
]


def test_lemma_numbers(spark):
    asked = {
        ("πῶς", "πωσ"): "G4459", ("πως", "πωσ"): "G4458", ("καρπός", "καρποσ"): "G2590", ("καταποντίζομαι", "καταποντιζομαι"): "G2669", ("ἄγνωστον", "αγνωστον"): None, ("οὕτω(ς)", "ουτω(σ)"): "G3779",
        ("Μωϋσῆς", "μωυσησ"): "G3475", ("Μωσῆς", "x"): "G3475", ("Ἕλλην", "ελλην"): "G1672", ("ἀπόλλυμι", "απολλυμι"): "G622", ("ὀμνύω", "ομνυω"): "G3660", ("εὐαγγελίζω", "ευαγγελιζω"): "G2097",
        ("χρυσοῦς", "χρυσουσ"): "G5552", ("τεσσεράκοντα", "τεσσερακοντα"): "G5062", ("nothing", None): None,
    }
    words = spark.createDataFrame([*asked, *asked, (None, "x"), ("", "y")], "lemma string, norm string")
    lexicon = spark.createDataFrame(LEXEMES, "strong string, lemma string, norm string")
    got = {(r.lemma, r.norm): r.strong for r in lemmas.lemma_numbers(words, lexicon).collect()}
    assert got == asked
