"""Sizes of pictures from the first bytes of their files, as column expressions: nothing is decoded."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by the formats: a PNG's first bytes up to its header chunk's name; a JPEG's start; its markers of frame headers, of
#: segments without a length, and of those after which no frame header comes (scan, end).
PNG, JPEG = "89504E470D0A1A0A0000000D49484452", "FFD8"
FRAMES = (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)
BARE, LAST = (0x01, *range(0xD0, 0xD9)), (0xD9, 0xDA)


def number(content: Column, at: Column | int, size: int) -> Column:
    """The big-endian number of `size` bytes from place `at` (1 is the first); null beyond the end."""
    piece = F.substring(content, F.lit(at) if isinstance(at, int) else at, F.lit(size))
    return F.when(F.octet_length(piece) == size, F.conv(F.hex(piece), 16, 10).cast("long"))


def jpeg_size(content: Column) -> Column:
    """(width, height) of the frame header that a walk from segment to segment comes to; null where there is none."""
    kind = "struct<at:int,width:long,height:long,done:boolean>"

    def state(at: Column, done: bool, width: Column | None = None, height: Column | None = None) -> Column:
        none = F.lit(None).cast("long")
        return F.struct(at.cast("int").alias("at"), (none if width is None else width).alias("width"), (none if height is None else height).alias("height"), F.lit(done).alias("done")).cast(kind)

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        marker, length = number(content, at, 2), number(content, at + 2, 2)
        low = marker % 256
        return (
            F.when(s["done"], s).when(marker.isNull() | (marker < 0xFF00) | low.isin(*LAST), state(at, True))
            .when(low == 0xFF, state(at + 1, False)).when(low.isin(*BARE), state(at + 2, False))
            .when(low.isin(*FRAMES), state(at, True, number(content, at + 7, 2), number(content, at + 5, 2)))
            .when(length.isNull(), state(at, True)).otherwise(state(at + 2 + length, False))
        )

    steps = F.sequence(F.lit(1), F.octet_length(content) + 1)  # a step goes on by a byte at least; those after the end do nothing
    return F.aggregate(steps, state(F.lit(3), False), step, lambda s: F.struct(s["width"].alias("width"), s["height"].alias("height")))


def size(content: Column) -> Column:
    """(width, height) of a PNG or JPEG file; null where it is neither, is cut off before its size, or has none."""
    png = F.struct(number(content, 17, 4).alias("width"), number(content, 21, 4).alias("height"))
    starts = lambda text: F.hex(F.substring(content, 1, len(text) // 2)) == text
    found = F.when(starts(PNG), png).when(starts(JPEG), jpeg_size(content))
    return F.when((found["width"] > 0) & (found["height"] > 0), found)
