"""Small office and mail files written with the standard library."""

from __future__ import annotations

import zipfile
from pathlib import Path

from paperloom.sources import office

CORE = (
    '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties"'
    ' xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/">'
    "<dc:title>{title}</dc:title><dc:creator>Ann</dc:creator><cp:keywords>a,b</cp:keywords>"
    "<dcterms:created>2024-01-02T03:04:05Z</dcterms:created></cp:coreProperties>"
)


def write_package(path: Path, parts: dict[str, tuple[str, str]], title: str = "T") -> None:
    """A package of parts: name -> (content type, XML)."""
    overrides = "".join(f'<Override PartName="/{n}" ContentType="{t}"/>' for n, (t, _) in parts.items())
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as package:
        package.writestr("[Content_Types].xml", f"<Types>{overrides}</Types>")
        package.writestr("docProps/core.xml", CORE.format(title=title))
        for name, (_, xml) in parts.items():
            package.writestr(name, xml)


def write_docx(path: Path, paragraphs: list[str], comment: str = "", title: str = "T") -> None:
    w = f'xmlns:w="{office.WORD_NS}"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    parts = {
        "word/document.xml": (
            office.MAIN_PARTS["word"], f"<w:document {w}><w:body>{body}</w:body></w:document>"
        )
    }
    if comment:
        parts["word/comments.xml"] = (
            office.COMMENT_PARTS["word"],
            f'<w:comments {w}><w:comment w:id="7" w:author="Bob" w:initials="B" w:date="2024-05-06T07:08:09Z">'
            f"<w:p><w:r><w:t>{comment}</w:t></w:r></w:p></w:comment></w:comments>",
        )
    write_package(path, parts, title)


def write_xlsx(path: Path, strings: list[str], comment: str) -> None:
    s = f'xmlns="{office.SHEET_NS}"'
    items = "".join(f"<si><t>{t}</t></si>" for t in strings)
    write_package(
        path,
        {
            "xl/workbook.xml": (office.MAIN_PARTS["excel"], f"<workbook {s}/>"),
            "xl/sharedStrings.xml": (office.TEXT_PARTS["excel"], f"<sst {s}>{items}</sst>"),
            "xl/comments1.xml": (
                office.COMMENT_PARTS["excel"],
                f'<comments {s}><commentList><comment ref="A1"><text><t>{comment}</t></text></comment>'
                "</commentList></comments>",
            ),
        },
    )


def write_pptx(path: Path, slides: list[str], comment: str) -> None:
    p = f'xmlns:p="{office.SLIDE_NS}" xmlns:a="{office.DRAWING_NS}"'
    parts = {"ppt/presentation.xml": (office.MAIN_PARTS["powerpoint"], f"<p:presentation {p}/>")}
    for i, text in enumerate(slides, start=1):
        xml = f"<p:sld {p}><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sld>"
        parts[f"ppt/slides/slide{i}.xml"] = (office.TEXT_PARTS["powerpoint"], xml)
    parts["ppt/comments/comment1.xml"] = (
        office.COMMENT_PARTS["powerpoint"],
        f'<p:cmLst {p}><p:cm dt="2024-02-03T04:05:06"><p:text>{comment}</p:text></p:cm></p:cmLst>',
    )
    write_package(path, parts)


def write_eml(path: Path, html: str | None, plain: str) -> None:
    from email.message import EmailMessage

    message = EmailMessage()
    message["Subject"] = "Hello"
    message["From"] = "Ann <ann@example.org>"
    message["To"] = "bob@example.org, Cid <cid@example.org>"
    message["Cc"] = "dan@example.org"
    message.set_content(plain)
    if html is not None:
        message.add_alternative(html, subtype="html")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(message.as_bytes())


def write_scan(root: Path) -> Path:
    """The folder of FIXTURES part B."""
    write_docx(root / "a.docx", ["First line", "second   line"], comment="A remark")
    write_docx(root / "sub" / "b.docx", ["Nested"], title="B")
    write_docx(root / "~$c.docx", ["Lock"])
    (root / "bad.docx").write_bytes(b"not a package")
    write_xlsx(root / "e.xlsx", ["Alpha", "Beta"], "cell remark")
    write_pptx(root / "p.pptx", ["Slide one", "Slide two"], "slide remark")
    write_eml(root / "m.eml", "<html><body><p>Dear&nbsp;Bob</p><p>Bye</p></body></html>", "plain")
    (root / "d.pdf").write_bytes(b"%PDF-1.4")
    return root
