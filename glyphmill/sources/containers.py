"""Small DOCX, XLSX and RTF writers, for tests and for the queries that read containers."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def pack(entries: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in entries.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def run(text: str, font: str | None = None) -> str:
    properties = f"<w:rPr><w:rFonts w:ascii={quoteattr(font)}/></w:rPr>" if font else ""
    return f'<w:r>{properties}<w:t xml:space="preserve">{escape(text)}</w:t></w:r>'


def paragraph(*runs: str, style: str | None = None) -> str:
    properties = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{properties}{''.join(runs)}</w:p>"


def table(rows: list[list[str]]) -> str:
    body = "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(run(c))}</w:tc>" for c in row) + "</w:tr>" for row in rows)
    return f"<w:tbl>{body}</w:tbl>"


def docx(*body: str, styles: str = "") -> bytes:
    headings = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{i}"><w:name w:val="heading {i}"/></w:style>' for i in range(1, 7))
    return pack({"word/document.xml": f"<w:document {_W}><w:body>{''.join(body)}</w:body></w:document>", "word/styles.xml": f"<w:styles {_W}>{headings}{styles}</w:styles>"})


def xlsx(sheets: dict[str, list[list[str]]], font: str = "Calibri", styles: str | None = None) -> bytes:
    """Sheets of cells given as XML, or as text where that does not begin with ``<c``."""
    entries, names, links = {}, [], []
    for k, (name, rows) in enumerate(sheets.items(), 1):
        body = "".join("<row>" + "".join(c if c.startswith("<c") else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in row) + "</row>" for row in rows)
        entries[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet {_X}><sheetData>{body}</sheetData></worksheet>"
        names.append(f'<sheet name={quoteattr(name)} sheetId="{k}" r:id="rId{k}"/>')
        links.append(f'<Relationship Id="rId{k}" Type="x" Target="worksheets/sheet{k}.xml"/>')
    entries["xl/workbook.xml"] = f"<workbook {_X} {_R}><sheets>{''.join(names)}</sheets></workbook>"
    entries["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(links)}</Relationships>'
    entries["xl/styles.xml"] = styles or f'<styleSheet {_X}><fonts><font><name val="{font}"/></font></fonts><cellXfs><xf fontId="0" numFmtId="0"/><xf fontId="0" numFmtId="14"/><xf fontId="0" numFmtId="22"/></cellXfs></styleSheet>'
    return pack(entries)
