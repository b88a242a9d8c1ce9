"""Text of PDF files that hold text: objects, Flate streams and the text operators; no fonts are drawn and nothing is recognised."""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/()<>\[\]]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes) -> bytes:
    octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], b"" if m[1] in b"\r\n" else m[1])
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", octal, raw[1:-1], flags=re.S)


def _objects(raw: bytes) -> dict[int, tuple[bytes, bytes]]:
    """Number to (dictionary, stream); objects inside object streams, too."""
    out: dict[int, tuple[bytes, bytes]] = {}
    for m in _OBJECT.finditer(raw):
        body = m[2]
        s = _STREAM.search(body)
        head, data = (body[: s.start()], body[s.end() : body.rfind(b"endstream")]) if s else (body, b"")
        if b"/FlateDecode" in head:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                data = b""
        out[int(m[1])] = (head, data)
    for head, data in list(out.values()):
        first, count = re.search(rb"/First\s+(\d+)", head), re.search(rb"/N\s+(\d+)", head)
        if b"/ObjStm" in head and first and count:
            numbers = [int(x) for x in data[: int(first[1])].split()][: 2 * int(count[1])]
            places = [*numbers[1::2], len(data)]
            for n, a, b in zip(numbers[::2], places, places[1:]):
                out.setdefault(n, (data[int(first[1]) + a : int(first[1]) + b if b < len(data) else None], b""))
    return out


def _to_unicode(cmap: bytes) -> dict[bytes, str]:
    """Codes to text of a font's character map."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: dict[bytes, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[bytes.fromhex(code.decode())] = text(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for low, high, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            start = int(to, 16)
            for k in range(int(low, 16), min(int(high, 16), int(low, 16) + 65535) + 1):
                out[k.to_bytes(len(low) // 2, "big")] = text(f"{start + k - int(low, 16):0{len(to)}x}".encode())
    return out


def _decoded(raw: bytes, codes: dict[bytes, str] | None) -> str:
    if not codes:
        return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
    width = len(next(iter(codes)))
    return "".join(codes.get(raw[i : i + width], "") for i in range(0, len(raw), width))


def _page_text(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    out, stack, codes = [], [], None
    for m in _TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(<[/+-.0123456789]":
            stack.append(t)
            continue
        texts = [_literal(x) if x[:1] == b"(" else bytes.fromhex(re.sub(rb"\s", b"", x[1:-1]).decode().ljust(2, "0")) if x[:1] == b"<" and len(x) % 2 == 0 else x for x in stack]
        if t == b"Tf" and stack:
            codes = fonts.get(next((x[1:] for x in stack if x[:1] == b"/"), b""))
        elif t in (b"Tj", b"'", b'"', b"TJ"):
            out.append("\n" if t in (b"'", b'"') else "")
            for x, raw in zip(stack, texts):
                if x[:1] in b"(<":
                    out.append(_decoded(raw, codes))
                elif t == b"TJ" and x[:1] == b"-" and float(x) < -200:  # a wide gap stands for a space
                    out.append(" ")
        elif t in (b"Td", b"TD") and len(stack) > 1 and float(stack[-1]):
            out.append("\n")
        elif t in (b"T*", b"ET", b"Tm"):
            out.append("\n")
        stack = []
    return re.sub(r"[ \t]*\n\s*", "\n", "".join(out)).strip()


def _reference(head: bytes, key: bytes) -> list[int]:
    m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", head)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


def pages(raw: bytes) -> list[str]:
    """One text for each page, in the order of the page tree."""
    if not raw.lstrip().startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    if b"/Encrypt" in raw[-4096:]:
        raise ValueError("the file is encrypted")
    objects = _objects(raw)
    order, seen = [], set()

    def visit(n: int) -> None:
        if n not in objects or n in seen:
            return
        seen.add(n)
        head = objects[n][0]
        if re.search(rb"/Type\s*/Pages\b", head):
            for k in _reference(head, b"Kids"):
                visit(k)
        elif re.search(rb"/Type\s*/Page\b", head):
            order.append(n)

    for n, (head, _) in objects.items():
        if re.search(rb"/Type\s*/Pages\b", head) and not _reference(head, b"Parent"):
            visit(n)
    for n in sorted(objects):  # pages that no tree holds
        if re.search(rb"/Type\s*/Page\b", objects[n][0]):
            visit(n)
    maps = {n: _to_unicode(data) for n, (_, data) in objects.items() if b"beginbfchar" in data or b"beginbfrange" in data}
    out = []
    for n in order:
        head = objects[n][0]
        resources = head + b"".join(objects[r][0] for r in _reference(head, b"Resources") if r in objects)
        resources += b"".join(objects[r][0] for r in _reference(resources, b"Font") if r in objects)
        fonts = {}
        for name, r in re.findall(rb"/([^\s/()<>\[\]]+)\s+(\d+)\s+\d+\s+R", resources):
            font = objects.get(int(r), (b"", b""))[0]
            to = next((k for k in _reference(font, b"ToUnicode") if k in maps), None)
            if to is not None:
                fonts[name] = maps[to]
        out.append(_page_text(b"\n".join(objects[r][1] for r in _reference(head, b"Contents") if r in objects), fonts))
    return out


def read_pdf(raw: bytes) -> list[str]:
    """Pages, each under a mark with its number; pages without text give the mark only."""
    return [f"[Page {i}]\n{t}".rstrip() for i, t in enumerate(pages(raw), 1)]


def metadata(raw: bytes) -> dict[str, str]:
    """Title, author and the like that the file states, and its number of pages."""
    out = {k.decode().lower(): _decoded(_literal(v), None) for k, v in re.findall(rb"/(Title|Author|Subject|Keywords|Creator|Producer|CreationDate)\s*(\((?:[^()\\]|\\.)*\))", raw)}
    return out | {"pages": str(len(pages(raw)))}


def tables(text: str) -> list[list[list[str]]]:
    """Tables of a page's text: two or more lines in a row whose cells are set apart by tabs, bars or wide gaps, with as many cells each."""
    out: list[list[list[str]]] = []
    now: list[list[str]] = []
    for line in [*text.split("\n"), ""]:
        cells = [c.strip() for c in re.split(r"\t+|\s*\|\s*|\s{3,}", line.strip(" |")) if c.strip()]
        if len(cells) > 1 and (not now or len(cells) == len(now[0])):
            now.append(cells)
        else:
            if len(now) > 1:
                out.append(now)
            now = [cells] if len(cells) > 1 else []
    return out
