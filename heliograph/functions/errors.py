"""Errors of reading and writing FITS."""


class FitsError(Exception):
    """Any of the errors below."""


class InvalidHeader(FitsError):
    pass


class UnexpectedEof(FitsError):
    pass


class InvalidBitpix(FitsError):
    pass


class InvalidKeyword(FitsError):
    pass


class UnsupportedExtension(FitsError):
    pass


class InvalidValue(FitsError):
    pass


class MissingKeyword(FitsError):
    pass


class UnsupportedCompression(FitsError):
    pass


class DecompressionError(FitsError):
    pass
