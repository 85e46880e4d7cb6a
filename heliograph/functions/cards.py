"""Header cards: value grammar, CONTINUE strings, validation and serialisation."""

from __future__ import annotations

import re
from typing import NamedTuple

from .blocks import BLOCK, CARD, pad_header
from .errors import InvalidHeader, InvalidKeyword, InvalidValue, MissingKeyword, UnexpectedEof


class ComplexInt(NamedTuple):
    re: int
    im: int


class Card(NamedTuple):
    """value is None, bool, int, float, str, complex or ComplexInt."""

    keyword: str
    value: object = None
    comment: str | None = None


_KEYWORD = re.compile(rb"[A-Z0-9 _-]{8}")
_INT = re.compile(r"[+-]?[0-9]+")
_FLOAT = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[ED][+-]?[0-9]+)?|[+-]?(?:INF|INFINITY|NAN)", re.I)
_QUOTED = re.compile(r"'((?:[^']|'')*)(?:'|\Z)", re.S)
COMMENTARY = ("COMMENT", "HISTORY", "")
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def parse_float(text: str) -> float | None:
    """A float with E or D exponent; underscores, which Python would take, are no part of the grammar."""
    if not _FLOAT.fullmatch(text):
        return None
    low = text.lower()
    return float(low if low.lstrip("+-")[0] in "in" else low.replace("d", "e"))


def parse_int(text: str) -> int | None:
    if not _INT.fullmatch(text):
        return None
    n = int(text)
    return n if LONG_MIN <= n <= LONG_MAX else None


def split_comment(text: str) -> tuple[str, str | None]:
    """The text before " /", and the comment after it (without one leading space) if there is one."""
    value, slash, comment = text.partition(" /")
    comment = comment.removeprefix(" ").rstrip()
    return value, comment or None if slash else None


def parse_complex(text: str):
    if not (text.startswith("(") and text.endswith(")")) or "," not in text:
        return None
    left, _, right = text[1:-1].partition(",")
    ints = parse_int(left.strip()), parse_int(right.strip())
    if None not in ints:
        return ComplexInt(*ints)
    parts = parse_float(left.strip()), parse_float(right.strip())
    return None if None in parts else complex(*parts)


def parse_value(field: str) -> tuple[object, str | None] | None:
    """(value, comment) of the value field of a card, None if it holds no value. String, logical, complex, integer, float, in this order."""
    if field.startswith("'"):
        m = _QUOTED.match(field)
        if not field[m.end() - 1 : m.end()] == "'" or m.end() < 2:
            return None
        return m[1].replace("''", "'").rstrip(), split_comment(field[m.end() :])[1]
    text, comment = split_comment(field)
    text = text.strip()
    if not text:
        return None
    if text in ("T", "F"):
        return text == "T", comment
    for parse in (parse_complex, parse_int, parse_float):
        if (value := parse(text)) is not None:
            return value, comment
    return None


def parse_card(raw: bytes) -> Card:
    if len(raw) != CARD or not _KEYWORD.fullmatch(raw[:8]):
        raise InvalidKeyword(repr(raw[:8]))
    keyword, text = raw[:8].decode().rstrip(), raw[8:].decode("latin-1")
    if keyword == "END":
        return Card(keyword)
    if keyword not in COMMENTARY and text.startswith("= "):
        found = parse_value(text[2:])
        if found:
            return Card(keyword, *found)
        rest = text[2:].strip()
        comment = rest[1:].strip() if rest.startswith("/") else split_comment(text[2:])[1]
        return Card(keyword, None, comment or None)
    return Card(keyword, None, text.rstrip() or None)


def continuation(card: Card) -> str:
    """The string of a CONTINUE card, which has it as a value or as text."""
    if isinstance(card.value, str):
        return card.value
    text = (card.comment or "").lstrip()
    m = _QUOTED.match(text)
    return m[1].replace("''", "'").rstrip() if m else text


def merge_continued(cards: list[Card]) -> list[Card]:
    """Strings that end in & take in the CONTINUE cards after them; other CONTINUE cards stay as they are."""
    out: list[Card] = []
    goes_on = False
    for card in cards:
        if goes_on and card.keyword == "CONTINUE":
            more = continuation(card)
            goes_on = more.endswith("&")
            out[-1] = out[-1]._replace(value=out[-1].value + more.removesuffix("&"))
            continue
        goes_on = isinstance(card.value, str) and card.value.endswith("&")
        out.append(card._replace(value=card.value.removesuffix("&")) if goes_on else card)
    return out


def parse_header(data: bytes) -> tuple[list[Card], int]:
    """Cards before END and the header's length in bytes (whole blocks)."""
    cards = []
    for at in range(0, len(data) - CARD + 1, CARD):
        raw = data[at : at + CARD]
        if raw[:8] == b"END     ":
            return merge_continued(cards), (at // BLOCK + 1) * BLOCK
        cards.append(parse_card(raw))
    raise UnexpectedEof("a header without END")


def read_header(stream) -> tuple[list[Card], int]:
    """The same from a stream, block by block."""
    data = b""
    while True:
        block = stream.read(BLOCK)
        if len(block) < BLOCK:
            raise UnexpectedEof("a header without END")
        data += block
        if any(block[i : i + 8] == b"END     " for i in range(0, BLOCK, CARD)):
            return parse_header(data)


# Look-up; the first card of a keyword counts.


def find(cards: list[Card], keyword: str) -> Card | None:
    return next((c for c in cards if c.keyword == keyword), None)


def first_value(cards: list[Card], keyword: str):
    """The value of the first card of that keyword that has one."""
    return next((c.value for c in cards if c.keyword == keyword and c.value is not None), None)


def int_value(cards: list[Card], keyword: str) -> int | None:
    v = first_value(cards, keyword)
    return v if isinstance(v, int) and not isinstance(v, bool) else None


def float_value(cards: list[Card], keyword: str) -> float | None:
    """A float; integers are taken as well."""
    v = first_value(cards, keyword)
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


def text_value(cards: list[Card], keyword: str) -> str | None:
    v = first_value(cards, keyword)
    return v if isinstance(v, str) else None


def bool_value(cards: list[Card], keyword: str) -> bool | None:
    v = first_value(cards, keyword)
    return v if isinstance(v, bool) else None


def need_int(cards: list[Card], keyword: str) -> int:
    v = int_value(cards, keyword)
    if v is None:
        raise MissingKeyword(keyword)
    if v < 0 and not keyword.endswith("BITPIX"):
        raise InvalidValue(f"{keyword} = {v}")
    return v


# Validation.

_FIRST = {"SIMPLE": None, "IMAGE": None, "TABLE": (8, 2), "BINTABLE": (8, 2)}
_PRESENT = {"SIMPLE": (), "IMAGE": ("PCOUNT", "GCOUNT"), "TABLE": ("NAXIS1", "NAXIS2", "PCOUNT", "GCOUNT", "TFIELDS"), "BINTABLE": ("NAXIS1", "NAXIS2", "PCOUNT", "GCOUNT", "TFIELDS")}


def hdu_type(cards: list[Card]) -> str | None:
    """SIMPLE, IMAGE, TABLE or BINTABLE, wherever the keyword stands."""
    if find(cards, "SIMPLE"):
        return "SIMPLE"
    kind = (text_value(cards, "XTENSION") or "").strip()
    return kind if kind in _FIRST else None


def validate(cards: list[Card], kind: str) -> None:
    """Mandatory keywords are there, in order, with the values that the kind asks for."""
    head = ("SIMPLE" if kind == "SIMPLE" else "XTENSION", "BITPIX", "NAXIS")
    for i, keyword in enumerate(head):
        if len(cards) <= i or cards[i].keyword != keyword:
            raise MissingKeyword(keyword) if not find(cards, keyword) else InvalidHeader(f"{keyword} is not card {i + 1}")
    if kind == "SIMPLE" and cards[0].value is not True or kind != "SIMPLE" and str(cards[0].value).strip() != kind:
        raise InvalidHeader(f"{head[0]} = {cards[0].value!r}")
    if _FIRST[kind] and (cards[1].value, cards[2].value) != _FIRST[kind]:
        raise InvalidHeader(f"BITPIX and NAXIS of a {kind} are {_FIRST[kind]}")
    for keyword in _PRESENT[kind]:
        if not find(cards, keyword):
            raise MissingKeyword(keyword)


# Serialisation.


def exponential(f: float, digits: int) -> str:
    """d.dddE5: no plus sign and no leading zero in the exponent."""
    mantissa, _, exponent = f"{f:.{digits}E}".partition("E")
    return f"{mantissa}E{int(exponent)}"


def format_float(f: float, most: int = 20) -> str:
    if f == 0:
        return "0.0"
    if f != f or f in (float("inf"), float("-inf")):
        raise InvalidValue(f"a header can't hold {f}")
    return next(s for d in range(15, -1, -1) if len(s := exponential(f, d)) <= most or d == 0)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''").ljust(8) + "'"


def format_value(value) -> str:
    """The value field, without trailing spaces; numbers end in column 30 of the card, complex ones in 40 or 60."""
    if isinstance(value, bool):
        return ("T" if value else "F").rjust(20)
    if isinstance(value, ComplexInt):
        return f"({value.re}, {value.im})".rjust(30)
    if isinstance(value, complex):
        return f"({format_float(value.real)}, {format_float(value.imag)})".rjust(50)
    if isinstance(value, int):
        return str(value).rjust(20)
    if isinstance(value, float):
        return format_float(value).rjust(20)
    return quoted(value)


def _card(text: str) -> bytes:
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError as e:
        raise InvalidValue(f"a header can't hold {text!r}") from e
    return raw[:CARD].ljust(CARD)


def format_card(card: Card) -> bytes:
    """One card, or several where a string is longer than 68 characters and goes on in CONTINUE cards."""
    keyword = card.keyword.ljust(8)
    if len(keyword) > 8 or not _KEYWORD.fullmatch(keyword.encode("latin-1", "replace")):
        raise InvalidKeyword(repr(card.keyword))
    if card.value is None:
        return _card(keyword + (card.comment or ""))
    note = f" / {card.comment}" if card.comment else ""
    if isinstance(card.value, str) and len(quoted(card.value)) > 70:
        pieces, rest = [], card.value
        while rest:
            n = 67
            while len(rest[:n].replace("'", "''")) > 67 or n < len(rest) and rest[n - 1] == " " and n > 1:
                n -= 1  # trailing spaces of a piece would be lost
            pieces.append(rest[:n])
            rest = rest[n:]
        lines = [(keyword + "= " if i == 0 else "CONTINUE  ") + "'" + p.replace("'", "''") + ("&'" if i < len(pieces) - 1 else "'") for i, p in enumerate(pieces)]
        lines[-1] += note if len(lines[-1]) + len(note) <= CARD else ""
        return b"".join(map(_card, lines))
    return _card(keyword + "= " + format_value(card.value).ljust(20) + note)


END = b"END".ljust(CARD)


def serialize(cards: list[Card]) -> bytes:
    """Header blocks: validated, ended and padded. An END among the cards is left out."""
    cards = [c for c in cards if c.keyword != "END"]
    kind = hdu_type(cards)
    if kind:
        validate(cards, kind)
    return pad_header(b"".join(map(format_card, cards)) + END)


def upsert(cards: list[Card], keyword: str, value, comment: str | None = None) -> list[Card]:
    """The cards with that keyword's first card changed, or a new card at the end."""
    for i, c in enumerate(cards):
        if c.keyword == keyword:
            return [*cards[:i], Card(keyword, value, comment or c.comment), *cards[i + 1 :]]
    return [*cards, Card(keyword, value, comment)]
