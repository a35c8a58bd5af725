"""Decks and exams as files: a package of XML parts (Office Open XML) for each document, written by the tasks that have its rows.

The sink is a Spark data source. A task writes its packages into a folder of its attempt; the driver's commit moves those of the
attempts that count to their place and drops the rest, so that a task that is killed, or runs twice, leaves nothing behind, and a
job that fails leaves the files as they were. Folders are reached through Arrow's file systems.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lectio.functions.deploy import deployed
from lectio.functions.text import file_stem
from lectio.operators.deck import index_font

FORMAT = "lectio_packages"
SCHEMA = "name string, kind string, font double, lines array<struct<section: string, slide_no: int, line_no: int, text: string>>"

# --- fixed values: names of Office Open XML ------------------------------------------------------------------------------
MAIN = "application/vnd.openxmlformats-officedocument"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006/main"
SLIDES = "http://schemas.openxmlformats.org/presentationml/2006/main"
WORDS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Characters that XML 1.0 can't hold, and the backslash that marks them
UNFIT = re.compile("[\x00-\x08\x0b\x0c\r\x0e-\x1f￾￿\\\\]")


def fit(text: str) -> str:
    """A text as XML can hold it; unfit() takes it back."""
    return escape(UNFIT.sub(lambda m: f"\\{ord(m[0]):04x}", text))


def unfit(text: str) -> str:
    return re.sub(r"\\([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), text)


def relations(*of: tuple[str, str]) -> str:
    rows = "".join(f'<Relationship Id="rId{k}" Type="{OFFICE}/{kind}" Target="{target}"/>' for k, (kind, target) in enumerate(of, 1))
    return f'{HEAD}<Relationships xmlns="{RELATIONS}">{rows}</Relationships>'


def types(**of: str) -> str:
    rows = "".join(f'<Override PartName="/{part}" ContentType="{MAIN}.{kind}+xml"/>' for part, kind in of.items())
    return f'{HEAD}<Types xmlns="{TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{rows}</Types>'


def shape(number: int, name: str, box: tuple[int, int, int, int], lines: list[str], points: float) -> str:
    x, y, w, h = box
    text = "".join(f'<a:p><a:r><a:rPr lang="es" sz="{round(points * 100)}"/><a:t>{fit(t)}</a:t></a:r></a:p>' for t in lines) or "<a:p/>"
    return (
        f'<p:sp><p:nvSpPr><p:cNvPr id="{number}" name="{name}"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="{w}" cy="{h}"/></a:xfrm>'
        f'<a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr><p:txBody><a:bodyPr/><a:lstStyle/>{text}</p:txBody></p:sp>'
    )


def tree(shapes: str) -> str:
    return f'<p:cSld><p:spTree><p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>{shapes}</p:spTree></p:cSld>'


def slide(title: str, lines: list[str], points: float) -> str:
    body = shape(2, "title", (500_000, 300_000, 8_100_000, 1_000_000), [title], 28) + shape(3, "body", (500_000, 1_400_000, 8_100_000, 4_900_000), lines, points)
    return f'{HEAD}<p:sld xmlns:p="{SLIDES}" xmlns:a="{DRAWING}" xmlns:r="{OFFICE}">{tree(body)}</p:sld>'


def theme() -> str:
    colors = "".join(f'<a:{n}><a:srgbClr val="{v}"/></a:{n}>' for n, v in zip("dk1 lt1 dk2 lt2 accent1 accent2 accent3 accent4 accent5 accent6 hlink folHlink".split(), ["000000", "FFFFFF"] * 6))
    fonts = "".join(f'<a:{n}Font><a:latin typeface="Arial"/><a:ea typeface=""/><a:cs typeface=""/></a:{n}Font>' for n in ("major", "minor"))
    fill = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>'
    look = f'<a:fillStyleLst>{fill * 3}</a:fillStyleLst><a:lnStyleLst>{f"<a:ln>{fill}</a:ln>" * 3}</a:lnStyleLst><a:effectStyleLst>{"<a:effectStyle><a:effectLst/></a:effectStyle>" * 3}</a:effectStyleLst><a:bgFillStyleLst>{fill * 3}</a:bgFillStyleLst>'
    return f'{HEAD}<a:theme xmlns:a="{DRAWING}" name="plain"><a:themeElements><a:clrScheme name="plain">{colors}</a:clrScheme><a:fontScheme name="plain">{fonts}</a:fontScheme><a:fmtScheme name="plain">{look}</a:fmtScheme></a:themeElements></a:theme>'


def deck_parts(lines: list[Row], font: float) -> Iterator[tuple[str, str]]:
    """The parts of a deck: cover, index, a slide for each title, conclusions. Rows are in the order of sections, slides and lines."""
    shown: list[tuple[str, list[str], float]] = []
    for line in lines:
        if line["section"] == "cover":
            shown.append((line["text"], [], 28))
        elif line["section"] == "content" and line["line_no"] == 0:
            shown.append((line["text"], [], 20))
        else:
            title = {"index": "Índice", "conclusions": "Conclusiones"}.get(line["section"])
            if title and (not shown or shown[-1][0] != title):
                shown.append((title, [], font if title == "Índice" else 20))
            shown[-1][1].append(line["text"])
    n = len(shown)
    master = '<p:clrMap bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" accent1="accent1" accent2="accent2" accent3="accent3" accent4="accent4" accent5="accent5" accent6="accent6" hlink="hlink" folHlink="folHlink"/>'
    space = f'xmlns:p="{SLIDES}" xmlns:a="{DRAWING}" xmlns:r="{OFFICE}"'
    kinds = {f"ppt/slides/slide{k}.xml": "presentationml.slide" for k in range(1, n + 1)}
    kinds |= {"ppt/presentation.xml": "presentationml.presentation.main", "ppt/slideMasters/slideMaster1.xml": "presentationml.slideMaster", "ppt/slideLayouts/slideLayout1.xml": "presentationml.slideLayout", "ppt/theme/theme1.xml": "theme"}
    yield "[Content_Types].xml", types(**kinds)
    yield "_rels/.rels", relations(("officeDocument", "ppt/presentation.xml"))
    ids = "".join(f'<p:sldId id="{255 + k}" r:id="rId{k + 1}"/>' for k in range(1, n + 1))
    yield "ppt/presentation.xml", f'{HEAD}<p:presentation {space}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId1"/></p:sldMasterIdLst><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>'
    yield "ppt/_rels/presentation.xml.rels", relations(("slideMaster", "slideMasters/slideMaster1.xml"), *(("slide", f"slides/slide{k}.xml") for k in range(1, n + 1)))
    yield "ppt/slideMasters/slideMaster1.xml", f'{HEAD}<p:sldMaster {space}>{tree("")}{master}<p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="rId1"/></p:sldLayoutIdLst></p:sldMaster>'
    yield "ppt/slideMasters/_rels/slideMaster1.xml.rels", relations(("slideLayout", "../slideLayouts/slideLayout1.xml"), ("theme", "../theme/theme1.xml"))
    yield "ppt/slideLayouts/slideLayout1.xml", f'{HEAD}<p:sldLayout {space} type="blank">{tree("")}</p:sldLayout>'
    yield "ppt/slideLayouts/_rels/slideLayout1.xml.rels", relations(("slideMaster", "../slideMasters/slideMaster1.xml"))
    yield "ppt/theme/theme1.xml", theme()
    for k, (title, body, points) in enumerate(shown, 1):
        yield f"ppt/slides/slide{k}.xml", slide(title, body, points)
        yield f"ppt/slides/_rels/slide{k}.xml.rels", relations(("slideLayout", "../slideLayouts/slideLayout1.xml"))


def exam_parts(lines: list[Row], font: float) -> Iterator[tuple[str, str]]:
    """The parts of an exam sheet: a paragraph for each line."""
    yield "[Content_Types].xml", types(**{"word/document.xml": "wordprocessingml.document.main"})
    yield "_rels/.rels", relations(("officeDocument", "word/document.xml"))
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{fit(line["text"])}</w:t></w:r></w:p>' for line in lines)
    yield "word/document.xml", f'{HEAD}<w:document xmlns:w="{WORDS}"><w:body>{body}</w:body></w:document>'


KINDS = {"deck": (deck_parts, "pptx"), "exam": (exam_parts, "docx")}


def package(kind: str, lines: list[Row], font: float) -> bytes:
    """The same rows give the same bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in KINDS[kind][0](lines, font):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text.encode(), zipfile.ZIP_DEFLATED)
    return out.getvalue()


# --- sink ------------------------------------------------------------------------------------------------------------


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[a-z][a-z0-9+.-]*:", path) else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's attempt, and what is in it."""

    folder: str
    names: list[str]


class PackageWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        fs, path = file_system(self.path)
        folder, names = f"{path}/_temporary-{self.job}/{uuid.uuid4().hex}", []
        fs.create_dir(folder, recursive=True)
        for row in rows:
            name = f"{row['name']}.{KINDS[row['kind']][1]}"
            with fs.open_output_stream(f"{folder}/{name}") as f:
                f.write(package(row["kind"], row["lines"], row["font"]))
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = file_system(self.path)
        if self.overwrite:
            self.drop(fs, path, lambda name: not name.startswith("_temporary"))
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{m.folder}/{name}", f"{path}/{name}")
        self.drop(fs, path, lambda name: name == f"_temporary-{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = file_system(self.path)
        self.drop(fs, path, lambda name: name == f"_temporary-{self.job}")

    @staticmethod
    def drop(fs, path: str, which) -> None:
        from pyarrow import fs as arrow

        for info in fs.get_file_info(arrow.FileSelector(path, allow_not_found=True)):
            if which(info.base_name):
                (fs.delete_dir if info.type == arrow.FileType.Directory else fs.delete_file)(info.path)


class PackageSource(DataSource):
    """spark.write.format("lectio_packages").save(folder): rows of SCHEMA, a file each."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> PackageWriter:
        return PackageWriter(self.options["path"], overwrite)


def write_packages(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    spark = deployed(rows.sparkSession)
    spark.dataSource.register(PackageSource)
    rows.write.format(FORMAT).mode(mode).save(path)


def named(doc: Column) -> Column:
    """A file name from an id: a digest tells ids apart that give the same stem."""
    return F.concat(file_stem(doc.cast("string")), F.lit("-"), F.left(F.md5(doc.cast("string")), F.lit(8)))


def deck_files(deck: DataFrame) -> DataFrame:
    """The rows of SCHEMA from deck_rows(): a deck for each document, its index in the size that its titles need."""
    place = F.when(F.col("section") == "cover", 0).when(F.col("section") == "index", 1).when(F.col("section") == "content", 2).otherwise(3)
    line = F.struct(place.alias("place"), F.col("slide_no").cast("int").alias("slide_no"), F.col("line_no").cast("int").alias("line_no"), "section", "text")
    index = F.when(F.col("section") == "index", F.char_length("text"))
    of = deck.groupBy("doc_id").agg(F.array_sort(F.collect_list(line)).alias("l"), F.count(index).alias("n"), F.coalesce(F.avg(index), F.lit(0.0)).alias("c"))
    lines = F.transform("l", lambda x: F.struct(x["section"].alias("section"), x["slide_no"].alias("slide_no"), x["line_no"].alias("line_no"), F.coalesce(x["text"], F.lit("")).alias("text")))
    return of.select(named(F.col("doc_id")).alias("name"), F.lit("deck").alias("kind"), index_font(F.col("n"), F.col("c")).alias("font"), lines.alias("lines"))


def exam_files(lines: DataFrame) -> DataFrame:
    """The same from exam_lines()."""
    of = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("line_no").cast("int").alias("line_no"), "line"))).alias("l"))
    rows = F.transform("l", lambda x: F.struct(F.lit("exam").alias("section"), F.lit(0).alias("slide_no"), x["line_no"].alias("line_no"), F.coalesce(x["line"], F.lit("")).alias("text")))
    return of.select(named(F.col("doc_id")).alias("name"), F.lit("exam").alias("kind"), F.lit(11.0).alias("font"), rows.alias("lines"))


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """name, part, line_no, text: the texts of packages in a folder, read back part by part."""
    deployed(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pptx,docx}").load(path).select("path", "content")

    def texts(batches):
        import xml.etree.ElementTree as ET

        import pyarrow as pa

        for batch in batches:
            rows = []
            for place, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for part in z.namelist():
                        if re.fullmatch(r"ppt/slides/slide\d+\.xml|word/document\.xml", part):
                            shown = [e.text or "" for e in ET.fromstring(z.read(part)).iter() if e.tag in (f"{{{DRAWING}}}t", f"{{{WORDS}}}t")]
                            rows += [(place.rsplit("/", 1)[-1], part, k, unfit(t)) for k, t in enumerate(shown)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))], ["name", "part", "line_no", "text"])

    return files.mapInArrow(texts, "name string, part string, line_no int, text string")
