"""Features of pictures against a plain version, over files written here."""

import math
import struct
import zlib

from tessera.sources import images


def png(path, pixels, kind):
    """8-bit samples; ``kind``: 0 grey, 2 RGB, 6 RGBA."""
    h, w = len(pixels), len(pixels[0])
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in pixels)

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def plain(pixels):
    """The definition in loops; ``pixels`` as red, green, blue and alpha."""

    def weights(size):
        scale = size / 12
        wide, out = max(scale, 1), []
        for i in range(12):
            row = []
            for x in range(size):
                t = (x + 0.5 - (i + 0.5) * scale) / wide
                row.append(0.0 if abs(t) >= 3 else 1.0 if t == 0 else math.sin(math.pi * t) * math.sin(math.pi * t / 3) * 3 / (math.pi * t) ** 2)
            out.append([v / sum(row) for v in row])
        return out

    flat = [[[math.floor(c * a / 255 + 255 * (1 - a / 255) + 0.5) if a < 255 else c for c in rgb] for *rgb, a in row] for row in pixels]
    down, across = weights(len(flat)), weights(len(flat[0]))
    colours, bins = [], [[0] * 16 for _ in range(4)]
    for i in range(12):
        for j in range(12):
            rgb = [min(255, max(0, math.floor(sum(down[i][y] * across[j][x] * flat[y][x][c] for y in range(len(flat)) for x in range(len(flat[0]))) + 0.5))) for c in range(3)]
            colours += [v / 127.5 - 1 for v in rgb]
            for k, v in enumerate([*rgb, math.floor(0.2126 * rgb[0] + 0.7152 * rgb[1] + 0.0722 * rgb[2] + 0.5)]):
                bins[k][min(15, int(v // 16))] += 1
    made = colours + [n / 144 for b in bins for n in b]
    length = math.sqrt(sum(v * v for v in made))
    return [v / length for v in made]


def test_features(spark, tmp_path):
    rgb = [[((x * 7) % 256, (y * 11) % 256, (x * y) % 256) for x in range(40)] for y in range(29)]
    rgba = [[(200, x * 20, 10, (x * y * 9) % 256) for x in range(12)] for y in range(12)]
    grey = [[((x * 50) % 256,) for x in range(5)] for _ in range(3)]
    png(tmp_path / "a.png", rgb, 2)
    png(tmp_path / "b.PNG", rgba, 6)
    (tmp_path / "deep").mkdir()
    png(tmp_path / "deep" / "c.png", grey, 0)
    (tmp_path / "bad.jpg").write_bytes(b"no picture")
    (tmp_path / "other.webp").write_bytes(b"RIFF....WEBP")
    (tmp_path / "note.txt").write_text("not looked at")
    jvm = spark._jvm
    solid = jvm.java.awt.image.BufferedImage(30, 20, 5)
    for x in range(30):
        for y in range(20):
            solid.setRGB(x, y, 0x2040C0)
    jvm.javax.imageio.ImageIO.write(solid, "jpg", jvm.java.io.File(str(tmp_path / "d.jpeg")))
    made = {r.path.rsplit("/", 1)[1]: r for r in images.image_features(spark, str(tmp_path)).collect()}
    assert {n: r.status for n, r in made.items()} == {"a.png": "OK", "b.PNG": "OK", "c.png": "OK", "d.jpeg": "OK", "bad.jpg": "UNREADABLE", "other.webp": "UNREADABLE"}
    whole = {"a.png": [[(*p, 255) for p in row] for row in rgb], "b.PNG": rgba, "c.png": [[(*p * 3, 255) for p in row] for row in grey], "d.jpeg": [[(0x20, 0x40, 0xC0, 255)] * 30] * 20}
    for name, pixels in whole.items():
        want = plain(pixels)
        assert len(made[name].features) == 496
        # A value on the edge of two roundings may fall either way; JPEG loses a little.
        near = [abs(g - w) for g, w in zip(made[name].features, want, strict=True)]
        assert max(near[:432]) < (0.004 if name == "d.jpeg" else 0.002), name
        assert made["bad.jpg"].features is None


def test_large_pictures_and_neighbours(spark, tmp_path, monkeypatch):
    for i, shade in enumerate((10, 12, 200, 240)):
        png(tmp_path / f"{i}.png", [[(shade, (x * 20) % 256, shade) for x in range(13)] for _ in range(13)], 2)
    made = images.image_features(spark, str(tmp_path)).cache()
    best = {r.query.rsplit("/", 1)[1]: r.path.rsplit("/", 1)[1] for r in images.alike(made, made, 1).collect()}
    assert best == {"0.png": "1.png", "1.png": "0.png", "2.png": "3.png", "3.png": "2.png"}
