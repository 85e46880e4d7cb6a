"""Header-data units of a file: found by seeking from header to header, classified, and described."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import prod

from ..functions.blocks import padded
from ..functions.cards import Card, bool_value, find, int_value, need_int, read_header, text_value, validate
from ..functions.errors import FitsError, InvalidBitpix, InvalidHeader, InvalidValue, MissingKeyword, UnexpectedEof, UnsupportedExtension
from . import files

PRIMARY, IMAGE, ASCII, BINARY, GROUPS, TILED = "primary", "image", "ascii_table", "binary_table", "random_groups", "compressed_image"
BITPIX = (8, 16, 32, 64, -32, -64)


@dataclass
class Hdu:
    path: str
    index: int
    kind: str
    bitpix: int
    naxes: list[int]
    header_start: int
    data_start: int
    data_len: int
    cards: list[Card] = field(repr=False)

    @property
    def extname(self) -> str | None:
        return text_value(self.cards, "EXTNAME")

    @property
    def pcount(self) -> int:
        return int_value(self.cards, "PCOUNT") or 0

    @property
    def gcount(self) -> int:
        return int_value(self.cards, "GCOUNT") or 1

    @property
    def tfields(self) -> int | None:
        return int_value(self.cards, "TFIELDS") if self.kind in (ASCII, BINARY, TILED) else None

    @property
    def shape(self) -> list[int]:
        """Axes of the image, for a tiled one those of the image that it holds."""
        if self.kind == TILED:
            return [need_int(self.cards, f"ZNAXIS{i + 1}") for i in range(need_int(self.cards, "ZNAXIS"))]
        if self.kind in (PRIMARY, IMAGE):
            return self.naxes
        raise InvalidHeader(f"HDU {self.index} is no image but a {self.kind}")

    @property
    def image_bitpix(self) -> int:
        self.shape  # noqa: B018  raises for what is no image
        value = need_int(self.cards, "ZBITPIX") if self.kind == TILED else self.bitpix
        if value not in BITPIX:
            raise InvalidBitpix(str(value))
        return value

    def table_shape(self) -> tuple[int, int]:
        """Bytes of a row, and rows, within the data."""
        if self.kind not in (ASCII, BINARY, TILED):
            raise InvalidHeader(f"HDU {self.index} is no table but a {self.kind}")
        width, rows = self.naxes
        if width * rows > self.data_len:
            raise UnexpectedEof("the table's rows exceed its data")
        return width, rows


def axes(cards: list[Card]) -> list[int]:
    return [need_int(cards, f"NAXIS{i + 1}") for i in range(need_int(cards, "NAXIS"))]


def data_length(cards: list[Card], primary: bool) -> int:
    """GCOUNT * (|BITPIX| / 8 * product of the axes + PCOUNT) bytes; random groups leave out the first axis, which is 0."""
    value, dims = abs(need_int(cards, "BITPIX")) // 8, axes(cards)
    if not dims:
        return 0
    if primary and dims[0] == 0 and bool_value(cards, "GROUPS"):
        return value * need_int(cards, "GCOUNT") * (need_int(cards, "PCOUNT") + prod(dims[1:]))
    if primary:
        return value * prod(dims)
    return (int_value(cards, "GCOUNT") or 1) * (value * prod(dims) + (int_value(cards, "PCOUNT") or 0))


def classify(cards: list[Card], primary: bool) -> str:
    if primary:
        dims = axes(cards)
        return GROUPS if dims and dims[0] == 0 and bool_value(cards, "GROUPS") else PRIMARY
    name = text_value(cards, "XTENSION")
    if name is None:
        raise MissingKeyword("XTENSION")
    kind = {"IMAGE": IMAGE, "TABLE": ASCII, "BINTABLE": BINARY}.get(name.strip())
    if kind is None:
        raise UnsupportedExtension(name)
    if kind in (ASCII, BINARY):
        need_int(cards, "TFIELDS")
        if len(axes(cards)) != 2:
            raise InvalidHeader("a table has two axes")
    return TILED if kind == BINARY and bool_value(cards, "ZIMAGE") else kind


def walk(stream, length: int, path: str = "", strict: bool = False) -> list[Hdu]:
    """All HDUs. Only headers are read. After the first, a header that can't be read ends the file quietly unless ``strict``;
    data that the file doesn't hold whole is always an error, padding may be missing."""
    found: list[Hdu] = []
    at = 0
    while length - at >= 2880 or at == 0:
        stream.seek(at)
        try:
            cards, n = read_header(stream)
            primary = not found
            if primary and not (cards and cards[0].keyword == "SIMPLE"):
                raise InvalidHeader("the first HDU must be primary")
            kind, size = classify(cards, primary), data_length(cards, primary)
            if strict:
                validate(cards, {PRIMARY: "SIMPLE", GROUPS: "SIMPLE", IMAGE: "IMAGE", ASCII: "TABLE"}.get(kind, "BINTABLE"))
            bitpix = need_int(cards, "BITPIX")
            dims = axes(cards)
        except FitsError:
            if found and not strict:
                break
            raise
        if size and at + n + size > length:
            raise UnexpectedEof(f"HDU {len(found)} of {path} is cut short")
        found.append(Hdu(path, len(found), kind, bitpix, dims, at, at + n, size, cards))
        at += n + padded(size)
    return found


def read_hdus(path: str, strict: bool = False) -> list[Hdu]:
    with files.open_read(path) as f:
        return walk(f, files.size(path), path, strict)


def choose(hdus: list[Hdu], which: str | int | None) -> Hdu:
    """By index, by exact EXTNAME (the first counts), or the first HDU with data."""
    if which is None or which == "":
        return next((h for h in hdus if h.data_len or h.kind in (ASCII, BINARY)), hdus[0])
    text = str(which)
    if text.lstrip("-").isdigit():
        if not 0 <= int(text) < len(hdus):
            raise InvalidValue(f"there is no HDU {text}")
        return hdus[int(text)]
    named = next((h for h in hdus if h.extname == text), None)
    if named is None:
        raise InvalidValue(f"no HDU is named {text!r}")
    return named


def primary_cards(bitpix: int, naxes: list[int]) -> list[Card]:
    if bitpix not in BITPIX:
        raise InvalidBitpix(str(bitpix))
    return [Card("SIMPLE", True, "conforms to FITS standard"), Card("BITPIX", bitpix), Card("NAXIS", len(naxes)), *(Card(f"NAXIS{i + 1}", n) for i, n in enumerate(naxes))]


def extension_cards(kind: str, bitpix: int, naxes: list[int], pcount: int = 0, gcount: int = 1, tfields: int | None = None) -> list[Card]:
    if kind not in ("IMAGE", "TABLE", "BINTABLE"):
        raise UnsupportedExtension(kind)
    if bitpix not in BITPIX:
        raise InvalidBitpix(str(bitpix))
    cards = [Card("XTENSION", kind), Card("BITPIX", bitpix), Card("NAXIS", len(naxes)), *(Card(f"NAXIS{i + 1}", n) for i, n in enumerate(naxes)), Card("PCOUNT", pcount), Card("GCOUNT", gcount)]
    return cards if tfields is None else [*cards, Card("TFIELDS", tfields)]


def has_keyword(hdu: Hdu, keyword: str) -> bool:
    return find(hdu.cards, keyword) is not None
