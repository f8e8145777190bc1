"""Image bytes: sizes from headers alone; pixel work where an imaging library is installed."""

from __future__ import annotations

import io
import re
import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The smallest side, the largest area, the side shown to models.
SMALLEST, LARGEST_AREA, SHOWN = 50, 178_956_970, 1024


def size_of(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) of a PNG, GIF or JPEG, from its header; None if unreadable."""
    if not data:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


@F.pandas_udf(T.BooleanType())
def too_small(data: pd.Series) -> pd.Series:
    def of(d):
        s = size_of(d)
        return None if s is None else s[0] < SMALLEST or s[1] < SMALLEST

    return pd.Series([of(d) for d in data], dtype=object)


def fitted(width: int, height: int, most_area: int) -> tuple[int, int]:
    """The size, shape kept, of at most an area."""
    if width * height <= most_area:
        return width, height
    ratio = (most_area / (width * height)) ** 0.5
    return max(1, int(width * ratio)), max(1, int(height * ratio))


def sized_svg(svg: str) -> str:
    """width and height 1000 where either is missing."""
    tag = re.search(r"<svg\b[^>]*>", svg)
    if not tag or (re.search(r"\swidth\s*=", tag[0]) and re.search(r"\sheight\s*=", tag[0])):
        return svg
    bare = re.sub(r"\s(?:width|height)\s*=\s*(\"[^\"]*\"|'[^']*')", "", tag[0])
    return svg[: tag.start()] + bare.replace("<svg", '<svg width="1000" height="1000"', 1) + svg[tag.end() :]


def _pillow():
    try:
        from PIL import Image
    except ImportError:
        return None
    Image.MAX_IMAGE_PIXELS = 4 * LARGEST_AREA  # larger ones are taken for an attack
    return Image


def _rasteriser():
    """A function from SVG bytes to PNG bytes, where a library for it is installed."""
    try:
        import cairosvg
    except (ImportError, OSError):
        return None
    return lambda data: cairosvg.svg2png(bytestring=data)


def is_svg(data: bytes | None) -> bool:
    head = (data or b"")[:4096].lstrip(b"\xef\xbb\xbf \t\r\n")
    return head.startswith(b"<svg") or head.startswith((b"<?xml", b"<!--", b"<!DOCTYPE")) and b"<svg" in head


def svg_as_png(data: bytes) -> bytes | None:
    """An SVG, sized if it has no size, as PNG; None without a rasteriser or if it can't be drawn."""
    draw = _rasteriser()
    if draw is None:
        return None
    try:
        return draw(sized_svg(data.decode("utf-8")).encode("utf-8"))
    except Exception:  # whatever a broken drawing raises, it has no pixels
        return None


def as_png(data: bytes | None, most_area: int = LARGEST_AREA, box: int | None = None) -> bytes | None:
    """PNG bytes: RGB, at most an area, at most a box; None if it can't be read.  Without an imaging
    library a PNG that needs no change passes, all else is None."""
    size = size_of(data)
    lib = _pillow()
    if lib is None:
        ok = data is not None and data[:4] == b"\x89PNG" and size and size[0] * size[1] <= most_area and (not box or max(size) <= box)
        return data if ok else None
    try:
        image = lib.open(io.BytesIO(data))
        image = image.convert("RGB") if image.mode in ("CMYK", "P") else image
        goal = fitted(*image.size, most_area)
        image = image.resize(goal) if goal != image.size else image
        if box:
            image.thumbnail((box, box))
        out = io.BytesIO()
        image.save(out, "PNG")
        return out.getvalue()
    except Exception:  # whatever a broken image raises, it has no pixels
        return None


def thumbnail(data: bytes | None) -> bytes | None:
    """At most SHOWN pixels either way; unreadable bytes pass as they are."""
    size = size_of(data)
    return data if size is None or max(size) <= SHOWN else as_png(data, box=SHOWN) or data


def for_classifier(data: bytes | None) -> bytes | None:
    """Smaller only where the area exceeds SHOWN squared."""
    size = size_of(data)
    return data if size is None or size[0] * size[1] <= SHOWN**2 else as_png(data, SHOWN**2) or data


def page_image(data: bytes | None) -> bytes | None:
    """What a fetched image becomes: None if too small or unreadable, else PNG."""
    if is_svg(data):
        return svg_as_png(data)
    size = size_of(data)
    if size and (size[0] < SMALLEST or size[1] < SMALLEST):
        return None
    return as_png(data)


@F.pandas_udf(T.BinaryType())
def page_images(data: pd.Series) -> pd.Series:
    return pd.Series([page_image(d) for d in data], dtype=object)
