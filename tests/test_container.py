"""The container file against a reader written from the format's description."""

import io
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlattice.operators import binning, norms, rows
from pairlattice.plans.fixture import CHROMOSOMES, chroms, pairs
from pairlattice.sources.container import Expected, Head, packed_block, write_container

SF = "/root/testdata/sf0.001"


class Reader:
    def __init__(self, data):
        self.data, self.f = data, io.BytesIO(data)

    def take(self, kind):
        out = struct.unpack("<" + kind, self.f.read(struct.calcsize("<" + kind)))
        return out if len(out) > 1 else out[0]

    def text(self):
        out = b""
        while (c := self.f.read(1)) != b"\0":
            out += c
        return out.decode()

    def expected(self, normed):
        norm, unit = self.text() if normed else "", self.text()
        resolution, n = self.take("iq")
        return norm, unit, resolution, np.frombuffer(self.f.read(4 * n), "<f4"), dict(self.take("if") for _ in range(self.take("i")))

    def head(self):
        assert self.f.read(4) == b"HIC\0" and self.take("i") == 9
        self.master = self.take("q")
        self.genome = self.text()
        self.nvi = self.take("qq")
        self.attributes = {self.text(): self.text() for _ in range(self.take("i"))}
        self.chromosomes = [(self.text(), self.take("q")) for _ in range(self.take("i"))]
        self.resolutions = [self.take("i") for _ in range(self.take("i"))]
        assert self.take("i") == 0
        self.begin = self.f.tell()

    def footer(self):
        self.f.seek(self.master)
        size = self.take("q")
        self.index = {self.text(): self.take("qi") for _ in range(self.take("i"))}
        self.raw = [self.expected(False) for _ in range(self.take("i"))]
        assert self.f.tell() == self.master + 8 + size
        self.normed = [self.expected(True) for _ in range(self.take("i"))]

    def vectors(self):
        self.f.seek(self.nvi[0])
        entries = [(self.text(), self.take("i"), self.text(), *self.take("iqq")) for _ in range(self.take("i"))]
        assert self.f.tell() == sum(self.nvi)
        out = {}
        for norm, c, unit, resolution, at, size in entries:
            n = struct.unpack("<q", self.data[at : at + 8])[0]
            assert size == 8 + 4 * n and unit == "BP"
            out[norm, resolution, c] = np.frombuffer(self.data[at + 8 : at + size], "<f4")
        return out

    def matrix(self, key):
        at, size = self.index[key]
        self.f.seek(at)
        c1, c2, n = self.take("iii")
        out = []
        for _ in range(n):
            assert self.text() == "BP"
            zoom, total, occupied, p5, p95, resolution, block_bins, columns, blocks = self.take("iffffiiii")
            out.append((zoom, total, occupied, resolution, block_bins, columns, [self.take("iqi") for _ in range(blocks)]))
        assert self.f.tell() == at + size
        return c1, c2, out


def unpacked(data):
    f = Reader(zlib.decompress(data))
    n, x0, y0 = f.take("iii")
    kinds = f.take("bbb")
    assert f.take("b") == 1
    v, x, y = ("f" if kinds[0] else "h"), ("i" if kinds[1] else "h"), ("i" if kinds[2] else "h")
    out = {}
    for _ in range(f.take(y)):
        row = f.take(y)
        for _ in range(f.take(x)):
            column = x0 + f.take(x)
            out[column, y0 + row] = f.take(v)
    assert len(out) == n and not f.f.read()
    return out


@pytest.mark.parametrize("top, step, n", [(5, 1, 3.0), (5, 1, 0.5), (5, 1, 40_000), (50_000, 7000, 1.0)])
def test_blocks_in_every_form(top, step, n):
    x, y = (a.ravel() + 11 for a in np.meshgrid(np.arange(0, top, step), np.arange(0, top, step)))
    values = np.arange(len(x)) % 3 + n
    assert unpacked(packed_block(x, y, values)) == {(a, b): v for a, b, v in zip(x.tolist(), y.tolist(), values.tolist())}


def test_a_reader_gets_the_cells_back(spark, tmp_path):
    p = pairs(spark, SF)
    cells = binning.multi_resolution(p, (1_000_000, 250_000, 2_000)).unionByName(binning.whole_genome(p, chroms(spark), 32_000_000))
    vectors = norms.vc(rows.intra_cells(cells)).select(F.lit("VC").alias("norm"), "resolution", "chr", "bin", "v")
    head = Head("g1", [("All", 32_000), *CHROMOSOMES], (2_000, 1_000_000, 250_000), {"a": "b"})
    some = [Expected(250_000, np.array([3.0, 2.5]), {1: 1.5, 2: 0.5}), Expected(250_000, np.array([1.0]), {1: 2.0}, "VC")]
    path = tmp_path / "set.one"
    write_container(str(path), head, cells, some, vectors)
    assert [x.name for x in tmp_path.iterdir()] == ["set.one"]
    r = Reader(path.read_bytes())
    r.head()
    r.footer()
    assert (r.genome, r.attributes, r.chromosomes, r.resolutions) == ("g1", {"a": "b"}, [("All", 32_000), *CHROMOSOMES], [1_000_000, 250_000, 2_000])
    found, used = {}, [(0, r.begin), (r.master, len(r.data) - r.master)]
    for key in r.index:
        c1, c2, zooms = r.matrix(key)
        used.append(r.index[key])
        assert key == f"{c1}_{c2}"
        for zoom, total, occupied, resolution, block_bins, columns, blocks in zooms:
            assert c1 == 0 or r.resolutions[zoom] == resolution
            mine = {}
            for block, at, size in blocks:
                used.append((at, size))
                part = unpacked(r.data[at : at + size])
                for x, y in part:
                    want = math.floor(math.log2(1 + abs(x - y) / math.sqrt(2) / block_bins)) * columns + (x + y) // 2 // block_bins if c1 == c2 else columns * (y // block_bins) + x // block_bins
                    assert block == want
                mine |= part
            assert occupied == len(mine) and total == sum(v * (2 if c1 == c2 and x != y else 1) for (x, y), v in mine.items())
            found |= {(resolution, c1, c2, x, y): v for (x, y), v in mine.items()}
    assert found == {(c["resolution"], c["chr1"], c["chr2"], c["x"], c["y"]): c["n"] for c in cells.collect()}
    used.sort()
    assert all(a + n == b for (a, n), (b, _) in zip(used, used[1:]))  # no gap, no overlap
    assert [(e[0], e[1], e[2], e[3].tolist(), e[4]) for e in r.raw + r.normed] == [("", "BP", 250_000, [3.0, 2.5], {1: 1.5, 2: 0.5}), ("VC", "BP", 250_000, [1.0], {1: 2.0})]
    read = r.vectors()
    want = {(v["norm"], v["resolution"], v["chr"], v["bin"]): v["v"] for v in vectors.collect()}
    assert {k[:3] for k in want} == set(read) and all(abs(read[k[:3]][k[3]] / v - 1) < 1e-6 for k, v in want.items())


def test_an_empty_set_is_a_file_too(spark, tmp_path):
    cells = binning.bin_pairs(pairs(spark, SF).limit(0), 1_000_000)
    write_container(str(tmp_path / "none"), Head("g", [("All", 1), ("chr1", 1000)], (1_000_000,)), cells)
    r = Reader((tmp_path / "none").read_bytes())
    r.head()
    r.footer()
    assert not r.index and not r.raw
