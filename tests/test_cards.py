import io

import pytest

from heliograph.functions.blocks import BLOCK, blocks_needed, pad_data, pad_header, padded, read_block, write_block
from heliograph.functions.cards import Card, ComplexInt, END, find, float_value, format_card, format_float, int_value, merge_continued, parse_card, parse_header, parse_value, read_header, serialize, upsert, validate
from heliograph.functions.errors import InvalidHeader, InvalidKeyword, InvalidValue, MissingKeyword, UnexpectedEof
from heliograph.sources.hdu import classify, data_length, extension_cards, primary_cards, walk


def card(text: str) -> Card:
    return parse_card(text.encode("latin-1").ljust(80))


def test_blocks():
    assert [blocks_needed(n) for n in (0, 1, 2880, 2881)] == [0, 1, 1, 2]
    assert padded(2881) == 5760 and pad_header(b"x")[-1:] == b" " and pad_data(b"x")[-1:] == b"\0"
    f = io.BytesIO(b"\0" * 2 * BLOCK)
    write_block(f, 1, b"a" * BLOCK)
    assert read_block(f, 1) == b"a" * BLOCK
    with pytest.raises(UnexpectedEof):
        read_block(f, 2)


@pytest.mark.parametrize(
    ("field", "value"),
    [
        ("'O''Brien '", "O'Brien"), ("''", ""), ("                   T", True), ("F / no", False), ("  42", 42), ("+5", 5), ("-32 /No. of bits", -32), ("1.5D3", 1500.0), ("1E2", 100.0), (".5", 0.5),
        ("(1, 2)", ComplexInt(1, 2)), ("(1.5, -2)", complex(1.5, -2)), ("9223372036854775808", 9.223372036854775808e18),
    ],
)
def test_values(field, value):
    got = parse_value(field)[0]
    assert got == value and type(got) is type(value)


@pytest.mark.parametrize("field", ["", "   ", "1_000", "abc", "'open"])
def test_no_values(field):
    assert parse_value(field) is None


def test_comments():
    assert card("BITPIX  =                  -32 /No. of bits").comment == "No. of bits"
    assert card("A       = 'x / y   '           / why").comment == "why"
    assert card("A       = 'x / y   '").value == "x / y"
    assert card("COMMENT   hello").comment == "  hello"
    with pytest.raises(InvalidKeyword):
        card("lower   = 1")


def test_continue():
    cards = [card("A       = 'Hello &'"), card("CONTINUE  'World'"), card("B       = 'x'"), card("CONTINUE  'alone'")]
    got = merge_continued(cards)
    assert got[0].value == "Hello World" and [c.keyword for c in got] == ["A", "B", "CONTINUE"]
    chain = merge_continued([card("A       = 'a&'"), card("CONTINUE  'b&'"), card("CONTINUE  'c'")])
    assert chain[0].value == "abc" and len(chain) == 1
    assert merge_continued([card("A       =  5"), card("CONTINUE  'b'")])[0].value == 5


@pytest.mark.parametrize("text", ["x" * 300, "it's " * 60, "a " * 90, "'" * 100, ""])
def test_long_strings_round_trip(text):
    cards, _ = parse_header(serialize([*primary_cards(8, []), Card("LONG", text)]))
    assert find(cards, "LONG").value == text.rstrip()


@pytest.mark.parametrize("value", [True, False, 0, -7, 2**62, 1.5, -2.5e-300, 1e30, "text", complex(1.25, -3.5), ComplexInt(3, -4)])
def test_round_trip(value):
    raw = format_card(Card("KEY", value, "note"))
    assert len(raw) == 80
    assert parse_card(raw) == Card("KEY", value, "note")


def test_float_text():
    assert format_float(0.0) == "0.0" and format_float(1.5e5) == "1.50000000000000E5"[:20] or len(format_float(1.5e5)) <= 20
    assert "+" not in format_float(1e10)
    with pytest.raises(InvalidValue):
        format_float(float("nan"))


def test_blank_keyword_text_stays():
    assert parse_card(format_card(Card("", None, "free text"))).comment == "free text"


def test_validation():
    validate(primary_cards(8, []), "SIMPLE")
    with pytest.raises(InvalidHeader):
        validate([Card("BITPIX", 8), Card("SIMPLE", True), Card("NAXIS", 0)], "SIMPLE")
    with pytest.raises(MissingKeyword):
        validate(extension_cards("IMAGE", 8, [1])[:-1], "IMAGE")
    with pytest.raises(InvalidHeader):
        validate(extension_cards("BINTABLE", 16, [1, 1], tfields=0), "BINTABLE")


def test_header_ends():
    data = serialize([*primary_cards(8, []), Card("END")])
    assert data.count(END.rstrip() + b" ") == 1
    with pytest.raises(UnexpectedEof):
        read_header(io.BytesIO(b" " * BLOCK))


def test_lookup_takes_the_first():
    cards = [Card("A", None, "x"), Card("A", 3), Card("A", 4), Card("F", 2)]
    assert int_value(cards, "A") == 3 and float_value(cards, "F") == 2.0 and int_value(cards, "Z") is None
    assert upsert(cards, "F", 5)[3].value == 5 and upsert(cards, "N", "new")[-1] == Card("N", "new")


def test_lengths():
    groups = [*primary_cards(-32, [0, 3, 4, 1, 1, 1]), Card("GROUPS", True), Card("PCOUNT", 6), Card("GCOUNT", 2)]
    assert data_length(groups, True) == 144 and classify(groups, True) == "random_groups"
    assert data_length(extension_cards("IMAGE", 16, [10, 10], gcount=0), False) == 200
    assert data_length(extension_cards("BINTABLE", 8, [4, 3], pcount=5, tfields=1), False) == 17
    assert data_length([c for c in extension_cards("IMAGE", 8, [7]) if c.keyword not in ("PCOUNT", "GCOUNT")], False) == 7


def file_of(*parts: bytes) -> tuple[io.BytesIO, int]:
    data = b"".join(parts)
    return io.BytesIO(data), len(data)


def test_walk_ends_quietly_or_not():
    first, image = serialize(primary_cards(8, [])), serialize(extension_cards("IMAGE", 8, [5]))
    assert len(walk(*file_of(first, image, b"12345"))) == 2  # padding may be missing
    assert len(walk(*file_of(first, b"junk" * 720))) == 1
    with pytest.raises(Exception):  # noqa: B017
        walk(*file_of(first, b"junk" * 720), strict=True)
    with pytest.raises(UnexpectedEof):
        walk(*file_of(first, image, b"123"))
    with pytest.raises(InvalidHeader):
        walk(*file_of(image))
    with pytest.raises(UnexpectedEof):
        walk(*file_of(b""))
