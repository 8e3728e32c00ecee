"""Uncompressed video as a table of frames."""

import numpy as np
import pytest

from lineweave.functions.pixels import gray
from lineweave.sources.frames import edge_frames
from lineweave.sources.video import Header, fps_text, register_video, to_bgr


def planes(seed, h, w, ph, pw):
    rng = np.random.default_rng(seed)
    return rng.integers(16, 236, h * w, dtype=np.uint8).tobytes() + rng.integers(16, 241, 2 * ph * pw, dtype=np.uint8).tobytes()


def write(path, frames, colour="420jpeg", h=9, w=11, head="F30000:1001 Ip A1:1", tail=b""):
    kind = next(c for c in ("420", "422", "444", "mono") if colour.startswith(c))
    ph, pw = {"420": (-(-h // 2), -(-w // 2)), "422": (h, -(-w // 2)), "444": (h, w), "mono": (0, 0)}[kind]
    data = [planes(i, h, w, ph, pw) for i in range(frames)]
    path.write_bytes(f"YUV4MPEG2 W{w} H{h} {head} C{colour}\n".encode() + b"".join(b"FRAME\n" + d for d in data) + tail)
    return data


def pixel(y, u, v):
    """BT.601 for one pixel."""
    y, u, v = 255 / 219 * (y - 16), 255 / 224 * (u - 128), 255 / 224 * (v - 128)
    return [min(255, max(0, round(x))) for x in (y + 1.772 * u, y - 0.344136 * u - 0.714136 * v, y + 1.402 * v)]


@pytest.mark.parametrize(("colour", "across", "down"), [("420jpeg", 2, 2), ("422", 2, 1), ("444", 1, 1)])
def test_pixels(tmp_path, colour, across, down):
    data = write(tmp_path / "a.y4m", 1, colour)[0]
    header = Header.read(str(tmp_path / "a.y4m"))
    image = to_bgr(data, header)
    ph, pw = header.plane
    for r in range(9):
        for c in range(11):
            at = 99 + (r // down) * pw + c // across
            assert image[r, c].tolist() == pytest.approx(pixel(data[r * 11 + c], data[at], data[at + ph * pw]), abs=1)


def test_frames_of_a_file(spark, tmp_path):
    register_video(spark)
    path = str(tmp_path / "clip.y4m")
    data = write(tmp_path / "clip.y4m", 7, tail=b"FRAME\nhalf")
    assert fps_text(path) == "29.97002997002997"
    header = Header.read(path)
    read = lambda: spark.read.format("y4m").option("frames_per_task", 2)
    got = sorted(read().load(path).collect(), key=lambda r: r.frame_index)
    assert [(r.video_id, r.frame_index, r.h, r.w) for r in got] == [("clip", i, 9, 11) for i in range(7)]
    assert all(bytes(r.image) == to_bgr(d, header).tobytes() for r, d in zip(got, data, strict=True))
    part = read().option("start", 3).option("end", 99).option("roi", "0,0.34,0.5,1").option("video_id", "v").load(path)
    rows = sorted(part.collect(), key=lambda r: r.frame_index)
    assert [(r.video_id, r.frame_index, r.h, r.w) for r in rows] == [("v", i, 6, 5) for i in range(3, 7)]
    assert bytes(rows[0].image) == to_bgr(data[3], header)[3:, :5].tobytes()
    assert edge_frames(read().load(path), (0.0, 0.0, 1.0, 1.0)).count() == 7


def test_odd_files(spark, tmp_path):
    register_video(spark)
    write(tmp_path / "none.y4m", 0)
    assert spark.read.format("y4m").load(str(tmp_path / "none.y4m")).collect() == []
    data = write(tmp_path / "grey.y4m", 1, "mono")
    row = spark.read.format("y4m").load(str(tmp_path / "grey.y4m")).first()
    assert np.abs(gray(np.frombuffer(row.image, np.uint8).reshape(9, 11, 3)).astype(int) - np.clip((np.frombuffer(data[0], np.uint8).reshape(9, 11).astype(float) - 16) * 255 / 219, 0, 255)).max() <= 1
    (tmp_path / "text.y4m").write_text("no video\n")
    with pytest.raises(ValueError, match="YUV4MPEG2"):
        Header.read(str(tmp_path / "text.y4m"))
    write(tmp_path / "deep.y4m", 1, "420p10")
    with pytest.raises(ValueError, match="not known"):
        Header.read(str(tmp_path / "deep.y4m"))
