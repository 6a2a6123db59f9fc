"""Text of PDF files, page by page: objects, object streams, fonts' character maps and text operators.

Pages whose text can't be named (scans, fonts without a character map) are empty. Encrypted files are refused.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import groupby

#: Most bytes of one stream unpacked, and depth of forms within forms.
STREAM_BYTES, FORMS = 64 << 20, 4
#: Words of a page that counts as text.
LEAST_WORDS = 15

# Glyph names that differ from the character they stand for.
GLYPHS = {"space": " ", "hyphen": "-", "period": ".", "comma": ",", "colon": ":", "semicolon": ";", "quoteright": "’", "quoteleft": "‘", "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl"}
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}

_lexeme = re.compile(rb"[\s\0]*(?:%[^\r\n]*[\s\0]*)*(<<|>>|[\[\]{}]|/[^\s\0<>\[\]()/%{}]*|<[0-9A-Fa-f\s]*>|\(|[^\s\0<>\[\]()/%{}]+)")
_number = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_paren = re.compile(rb"\\(?:[0-7]{1,3}|\r\n|.)|[()]", re.S)
_object = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")


class Ref(int):
    """The number of another object."""


class Word(bytes):
    """A keyword or operator."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """The string whose opening parenthesis ends at `at`, and where it ends."""
    out, depth, begin = [], 1, at
    for m in _paren.finditer(data, at):
        c = m.group()
        if c[:1] == b"\\":
            code = c[1:]
            plain = bytes([int(code, 8) & 255]) if code[:1].isdigit() and code[:1] < b"8" else b"" if code in (b"\r\n", b"\n", b"\r") else ESCAPES.get(code, code)
            out += [data[begin : m.start()], plain]
            begin = m.end()
            continue
        depth += 1 if c == b"(" else -1
        if not depth:
            return b"".join([*out, data[begin : m.start()]]), m.end()
    return b"".join([*out, data[begin:]]), len(data)


def parsed(data: bytes, at: int = 0, until: tuple[bytes, ...] = ()) -> tuple[list, int]:
    """The values from `at` on, up to a keyword of `until`, and where that ends. Names are str, strings bytes."""
    stack: list[list] = [[]]
    while m := _lexeme.match(data, at):
        x, at = m[1], m.end()
        top = stack[-1]
        if x in (b"<<", b"["):
            stack.append([])
        elif x in (b">>", b"]"):
            if len(stack) > 1:
                done = stack.pop()
                stack[-1].append(done if x == b"]" else {k: v for k, v in zip(done[::2], done[1::2], strict=False) if isinstance(k, str)})
        elif x == b"(":
            text, at = _string(data, at)
            top.append(text)
        elif x[:1] == b"<":
            digits = re.sub(rb"\s", b"", x[1:-1])
            top.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        elif x[:1] == b"/":
            top.append(re.sub(r"#([0-9A-Fa-f]{2})", lambda h: chr(int(h[1], 16)), x[1:].decode("latin-1")))
        elif _number.fullmatch(x):
            top.append(float(x) if b"." in x else int(x))
        elif x == b"R" and len(top) > 1 and isinstance(top[-2], int):
            top[-2:] = [Ref(top[-2])]
        elif x in until:
            return stack[0], at
        else:
            top.append(Word(x))
            if x == b"ID":  # bytes of an inline image
                end = re.compile(rb"\sEI(?=\s|$)").search(data, at)
                at = end.end() if end else len(data)
    return stack[0], at


class Document:
    def __init__(self, data: bytes) -> None:
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        at, packed = 0, []
        while m := _object.search(data, at):
            n = int(m[1])
            values, at = parsed(data, m.end(), (b"endobj", b"stream"))
            self.objects[n] = value = values[0] if values else None
            self.streams.pop(n, None)
            if data[at - 6 : at] == b"stream" and isinstance(value, dict):
                begin = at + (2 if data[at : at + 2] == b"\r\n" else 1)
                size = value.get("Length")
                known = type(size) is int and re.match(rb"\s*endstream", data[begin + size : begin + size + 16])
                end = begin + size if known else data.find(b"endstream", begin)
                end = len(data) if end < 0 else end
                self.streams[n] = data[begin:end]
                at = end
                if value.get("Type") == "ObjStm":
                    packed.append(n)
        for n in packed:
            body, first = self.stream(n), int(self.at(self.objects[n].get("First", 0)))
            heads = [x for x in parsed(body[:first])[0] if isinstance(x, int)]
            for k, where in zip(heads[::2], heads[1::2], strict=False):
                values = parsed(body[first + where :], 0, (b"endobj",))[0] if k not in self.objects else None
                if values:
                    self.objects[k] = values[0]
        trailers = [v[0] for m in re.finditer(rb"\btrailer\b", data) if (v := parsed(data, m.end(), (b"startxref",))[0]) and isinstance(v[0], dict)]
        heads = trailers + [v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "XRef"]
        if any("Encrypt" in t for t in heads):
            raise ValueError("the file is locked")
        roots = [r for t in heads if isinstance(r := self.at(t.get("Root")), dict)] + [v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"]
        if not roots:
            raise ValueError("no pages")
        self.root = roots[-1] if trailers else roots[0]

    def at(self, x):
        """x, or what it refers to."""
        for _ in range(16):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(int(x))
        return None

    def stream(self, ref) -> bytes:
        """The unpacked bytes of a stream; empty for filters other than Flate."""
        head, raw = self.objects.get(int(ref)), self.streams.get(int(ref))
        if raw is None or not isinstance(head, dict):
            return b""
        filters = self.at(head.get("Filter", []))
        for f in filters if isinstance(filters, list) else [filters]:
            if self.at(f) not in ("FlateDecode", "Fl"):
                return b""
            unpack = zlib.decompressobj()
            try:
                raw = unpack.decompress(raw, STREAM_BYTES)
            except zlib.error:
                return b""
            if unpack.unconsumed_tail:
                raise ValueError("a stream is too large")
        return raw

    def pages(self) -> Iterator[dict]:
        """The pages in order, each with the resources that it inherits."""
        waiting, seen = [(self.root.get("Pages"), {})], set()
        while waiting:
            ref, resources = waiting.pop()
            node = self.at(ref)
            if not isinstance(node, dict) or isinstance(ref, Ref) and int(ref) in seen:
                continue
            seen.add(int(ref) if isinstance(ref, Ref) else -1)
            resources = node.get("Resources", resources)
            if "Kids" in node:
                waiting += [(k, resources) for k in reversed(self.at(node["Kids"]) or [])]
            else:
                yield node | {"Resources": resources}

    def font(self, font: dict):
        """A function from a string's bytes to its text."""
        ref = font.get("ToUnicode")
        if isinstance(ref, Ref) and (names := self.stream(ref)):
            return character_map(names)
        if font.get("Subtype") == "Type0":
            return lambda s: ""
        encoding = self.at(font.get("Encoding"))
        base = encoding.get("BaseEncoding") if isinstance(encoding, dict) else encoding
        kind, own, code = "mac_roman" if base == "MacRomanEncoding" else "cp1252", {}, 0
        for x in self.at(encoding.get("Differences", [])) if isinstance(encoding, dict) else []:
            if isinstance(x, int):
                code = x
            elif isinstance(x, str):
                if x in GLYPHS or len(x) == 1:
                    own[code] = GLYPHS.get(x, x)
                code += 1
        return lambda s: "".join(own.get(c) or bytes([c]).decode(kind, "replace") for c in s)

    def text(self, content: bytes, resources, depth: int = 0) -> str:
        """The text that content shows; a new line where it moves up or down, a blank where it moves along a line."""
        resources = self.at(resources) or {}
        fonts, forms = (self.at(resources.get(k)) or {} for k in ("Font", "XObject"))
        shown, known, read = [], {}, lambda s: s.decode("cp1252", "replace")
        x = y = lead = 0.0
        last, held = None, []

        def show(s: bytes) -> None:
            nonlocal last
            if last and last != (x, y):
                shown.append(" " if abs(last[1] - y) < 1 else "\n")
            last = (x, y)
            shown.append(read(s))

        for v in parsed(content)[0]:
            if not isinstance(v, Word):
                held.append(v)
                continue
            numbers = [h for h in held if isinstance(h, (int, float))]
            match bytes(v):
                case b"Tf" if held and isinstance(held[0], str):
                    if held[0] not in known:
                        font = self.at(fonts.get(held[0]))
                        known[held[0]] = self.font(font) if isinstance(font, dict) else read
                    read = known[held[0]]
                case b"BT":
                    x = y = 0.0
                case b"TL" if numbers:
                    lead = numbers[0]
                case b"Td" | b"TD" if len(numbers) == 2:
                    x, y = x + numbers[0], y + numbers[1]
                    lead = -numbers[1] if v == b"TD" else lead
                case b"Tm" if len(numbers) == 6:
                    x, y = numbers[4:]
                case b"T*":
                    y -= lead or 10
                case b"cm" | b"Q" if last:
                    last = (last[0], float("inf"))
                case b"Tj" | b"'" | b'"' if held and isinstance(held[-1], bytes):
                    y -= (lead or 10) if v != b"Tj" else 0
                    show(held[-1])
                case b"TJ" if held and isinstance(held[-1], list):
                    show(b"")
                    for part in held[-1]:
                        if isinstance(part, bytes):
                            shown.append(read(part))
                        elif isinstance(part, (int, float)) and part < -200:
                            shown.append(" ")
                case b"Do" if held and depth < FORMS and isinstance(forms.get(held[-1]) if isinstance(held[-1], str) else None, Ref):
                    form = self.at(forms[held[-1]])
                    if isinstance(form, dict) and form.get("Subtype") == "Form":
                        shown += ["\n", self.text(self.stream(forms[held[-1]]), form.get("Resources", resources), depth + 1)]
            held = []
        return "".join(shown)


def character_map(names: bytes):
    """The function that a font's map from codes to Unicode stands for."""
    to, widths, held, inside = {}, set(), [], b""
    utf = lambda s: s.decode("utf-16-be", "replace")
    for v in parsed(names)[0]:
        if not isinstance(v, Word):
            held.append(v)
            continue
        if v.startswith(b"begin"):
            inside = v[5:]
        elif v == b"endcodespacerange":
            widths |= {len(h) for h in held if isinstance(h, bytes)}
        elif v == b"endbfchar" and inside == b"bfchar":
            to |= {a: utf(b) for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
        elif v == b"endbfrange" and inside == b"bfrange":
            for a, b, c in zip(held[::3], held[1::3], held[2::3], strict=False):
                low, many = int.from_bytes(a), min(int.from_bytes(b) - int.from_bytes(a) + 1, 1 << 16)
                for k in range(many):
                    target = c[k] if isinstance(c, list) and k < len(c) else (int.from_bytes(c) + k).to_bytes(max(len(c), 2)) if isinstance(c, bytes) else b""
                    to[(low + k).to_bytes(len(a))] = utf(target)
        held = []
    width = max(widths, default=1)
    return lambda s: "".join(to.get(s[k : k + width], "") for k in range(0, len(s), width))


def page_texts(content: bytes) -> list[str]:
    """The text of each page, with words joined that a line end divides."""
    document, out = Document(content), []
    for page in document.pages():
        parts = page.get("Contents")
        streams = parts if isinstance(parts, list) else document.at(parts) if isinstance(document.at(parts), list) else [parts]
        body = b"\n".join(document.stream(r) for r in streams if isinstance(r, Ref))
        text = document.text(body, page["Resources"]).replace("\u00ad", "")
        out.append(re.sub(r"(\w)-[ \t]*\n[ \t]*(\w)", r"\1\2", text))
    return out


def pdf_parts(content: bytes) -> list[tuple[str, bool, str]]:
    """(label, kept, text) of the stretches of pages with text and without; stretches of no text at all are left out."""
    try:
        pages = page_texts(content)
    except (TypeError, AttributeError, OverflowError, RecursionError) as e:
        raise ValueError("the file is damaged") from e
    out = []
    for has, run in groupby(enumerate(pages, 1), lambda p: len(p[1].split()) >= LEAST_WORDS):
        run = list(run)
        label = f"pages {run[0][0]}–{run[-1][0]}" + ("" if has else " — image-only / blank (no usable text)")
        out.append((label, has, "\n\n".join(t for _, t in run) + "\n\n"))
    return [p for p in out if p[2].strip()]
