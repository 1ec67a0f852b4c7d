"""The encoding of a file, told from its first bytes."""

from __future__ import annotations

# Byte order marks, longest first, and the encodings that are tried without one.
MARKS = [(b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")]
FALLBACKS = ["utf-8", "latin-1", "cp1252", "utf-16"]
SAMPLE_BYTES = 65_536
SURE = 0.70


def detect(raw: bytes, sample: int = SAMPLE_BYTES) -> str:
    """By byte order mark, else UTF-8 if it decodes (a character cut at the end of the sample is no fault), else by
    charset_normalizer where it is installed and sure, else the first fallback that decodes."""
    head = raw[:sample]
    for mark, name in MARKS:
        if head.startswith(mark):
            return name
    try:
        head.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError as e:
        if len(raw) > sample and e.start >= len(head) - 3:
            return "utf-8"
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(head).best()
        if best and 1 - best.chaos >= SURE:
            return "utf-8" if best.encoding == "ascii" else best.encoding.replace("_", "-")
    except ImportError:
        pass
    for name in FALLBACKS:
        try:
            head.decode(name)
            return name
        except UnicodeDecodeError:
            continue
    return "latin-1"


#: What Spark's readers call it.
SPARK_NAMES = {"latin-1": "ISO-8859-1", "iso8859-1": "ISO-8859-1", "cp1252": "windows-1252", "utf-8": "UTF-8", "utf-16": "UTF-16", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "utf-32-le": "UTF-32LE", "utf-32-be": "UTF-32BE"}


def spark_name(encoding: str) -> str:
    return SPARK_NAMES.get(encoding, encoding)
