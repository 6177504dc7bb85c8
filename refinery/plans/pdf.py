"""A plain PDF of text lines, without libraries: one font, bold headings, pages as needed."""

from __future__ import annotations

import re
import textwrap

WIDTH, HEIGHT, MARGIN, SIZE, LEADING = 595, 842, 50, 9, 12
COLUMNS = 100


def lines_of(markdown: str) -> list[tuple[str, bool]]:
    """(text, whether it is a heading) of each printed line; tables keep their rows, wide lines are folded."""
    out: list[tuple[str, bool]] = []
    for raw in markdown.splitlines():
        heading = raw.startswith("#")
        text = re.sub(r"\*\*(.*?)\*\*", r"\1", raw.lstrip("#").strip() if heading else raw.rstrip())
        if re.fullmatch(r"\|(\s*-+\s*\|)+", text):
            continue
        out += [(part, heading) for part in textwrap.wrap(text, COLUMNS, subsequent_indent="    ") or [""]]
    return out


def _escaped(text: str) -> bytes:
    plain = text.replace("→", "->").replace("—", "-").replace("≤", "<=").replace("–", "-")
    return plain.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")


def pdf(markdown: str) -> bytes:
    """The document as bytes."""
    lines, per_page = lines_of(markdown), (HEIGHT - 2 * MARGIN) // LEADING
    pages = [lines[i : i + per_page] for i in range(0, len(lines), per_page)] or [[]]
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    for k, name in enumerate((b"Courier", b"Courier-Bold")):
        objects.append(b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>" % name)
    kids = []
    for page in pages:
        body = b"BT %d TL %d %d Td\n" % (LEADING, MARGIN, HEIGHT - MARGIN)
        for text, heading in page:
            body += b"/F%d %d Tf (%s) Tj T*\n" % (2 if heading else 1, SIZE, _escaped(text))
        body += b"ET"
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Contents %d 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % (WIDTH, HEIGHT, len(objects)))
        kids.append(len(objects))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, places = b"%PDF-1.4\n", []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))
