"""Tiny images and masks for the tests."""

import struct
import zlib


def png(path, rows, colour=False):
    """Write a tiny PNG: ``rows`` of grey values or of (r, g, b) triples."""
    height, width = len(rows), len(rows[0])
    raw = b"".join(
        b"\x00" + (b"".join(bytes(p) for p in row) if colour else bytes(row)) for row in rows
    )

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    header = struct.pack(">IIBBBBB", width, height, 8, 2 if colour else 0, 0, 0, 0)
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    with open(path, "wb") as out:
        out.write(data)


def bmp(path, rows):
    """Write a 24-bit BMP from rows of (r, g, b) triples."""
    height, width = len(rows), len(rows[0])
    pad = b"\x00" * (-width * 3 % 4)
    body = b"".join(b"".join(bytes((b, g, r)) for r, g, b in row) + pad for row in reversed(rows))
    header = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0)
    with open(path, "wb") as out:
        out.write(header + info + body)


def mask_df(spark, rasters):
    """Mask rows from ``{image_id: list of rows of 0/1}``."""
    rows = []
    for key, raster in rasters.items():
        runs = []
        for y, line in enumerate(raster):
            x = 0
            while x < len(line):
                if line[x]:
                    start = x
                    while x + 1 < len(line) and line[x + 1]:
                        x += 1
                    runs.append((y, start, x))
                x += 1
        rows.append((key, len(raster), len(raster[0]), runs))
    return spark.createDataFrame(
        rows, "image_id string, height int, width int, runs array<struct<y:int,x0:int,x1:int>>"
    )


def raster(height, width, *boxes):
    """0/1 rows with inclusive boxes ``(y0, y1, x0, x1)`` set."""
    out = [[0] * width for _ in range(height)]
    for y0, y1, x0, x1 in boxes:
        for y in range(y0, y1 + 1):
            for x in range(x0, x1 + 1):
                out[y][x] = 1
    return out
