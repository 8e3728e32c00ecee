import random
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineweave.config import Options, frame_range, gap_seconds, read_ini, supplement_options
from lineweave.functions import pixels
from lineweave.functions.text import bare, escape_markup, file_name, match_form, normalize_text, similarity, text_key
from lineweave.functions.timefmt import frame_to_time, seconds_to_time
from lineweave.streaming.lines import edit_distance


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_match_form_folds_kana_after_nfkc_and_drops_punctuation():
    assert match_form("ｧ ッ!、　x") == "アツx"
    assert match_form(r"a\Nb\nc") == "abc"
    assert bare("ッ 。x\u001c") == "ッx"


def test_arrow_forms_agree_and_keep_nulls(spark):
    rows = [("ｧ ッ!",), (None,), ("",)]
    df = spark.createDataFrame(rows, "t string").select(normalize_text("t").alias("n"), text_key("t").alias("k"))
    assert [tuple(r) for r in df.collect()] == [("アツ", "ァッ"), (None, None), ("", "")]


def test_edit_distance_against_table():
    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1]

    rng = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randrange(90))) for _ in range(2))
        assert edit_distance(a, b) == table(a, b)


def test_similarity_is_zero_for_empty(spark):
    row = one(spark, similarity(F.lit(""), F.lit("a")), similarity(F.lit("abcd"), F.lit("abce")))
    assert row[0] == 0.0
    assert row[1] == 0.75


def test_escape_and_file_name(spark):
    text = "a\\b{c}\r\nd\re\nf"
    row = one(spark, escape_markup(F.lit(text)), file_name(F.lit("Demo: Story One")))
    assert row[0] == "a＼b｛c｝\\Nd\\Ne\\Nf"
    assert row[1] == "Demo__Story_One"


@pytest.mark.parametrize(
    ("frame", "fps", "text"),
    [(45, "30", "0:00:01.50"), (1, "23.976023976023978", "0:00:00.04"), (30, "29.97002997002997", "0:00:01.00"), (108000, "30.0", "1:00:00.00")],
)
def test_frame_times(spark, frame, fps, text):
    assert one(spark, frame_to_time(F.lit(frame), fps))[0] == text


def test_frame_times_truncate_exactly(spark):
    fps = "23.976023976023978"
    rows = spark.range(0, 200000, 37).select("id", frame_to_time(F.col("id"), fps).alias("t")).collect()
    for frame, text in rows:
        cs = int(Fraction(frame * 100) / Fraction(Decimal(fps)))
        assert text == f"{cs // 360000}:{cs % 360000 // 6000:02d}:{cs % 6000 // 100:02d}.{cs % 100:02d}"


def test_script_seconds_round_half_to_even(spark):
    row = one(spark, seconds_to_time(F.lit(0.125)), seconds_to_time(F.lit(-3.0)), seconds_to_time(F.lit(3600.0)))
    assert tuple(row) == ("0:00:00.12", "0:00:00.00", "1:00:00.00")


def test_options_are_validated():
    assert supplement_options(Options()).min_confidence == 0.85
    assert Options.read({"lookahead": "3", "roi": "[0, 0, 1, 1]"}).lookahead == 3
    for bad in ({"roi": "[1, 0, 0, 1]"}, {"ocr_interval": "0"}, {"recheck_interval": "0.1"}, {"min_similarity": "1.5"}, {"confirmations": "0"}, {"candidate_margin": "0"}):
        with pytest.raises(ValueError):
            Options.read(bad)
    with pytest.raises(ValueError):
        frame_range("5:5")
    with pytest.raises(ValueError):
        gap_seconds(float("nan"))
    assert frame_range("5:9", 9) == (5, 9)


def test_ini(tmp_path):
    (tmp_path / "c.ini").write_text("[Hybrid]\nlookahead = 7\n", encoding="utf-8")
    assert Options.read(read_ini(str(tmp_path / "c.ini"))["Hybrid"]).lookahead == 7


def test_overlap_tolerates_one_pixel():
    a = np.zeros((8, 20), dtype=bool)
    a[3, 2:14] = True
    assert pixels.overlap(a, np.roll(a, 1, axis=0)) == 1.0
    assert pixels.overlap(a, np.roll(a, 3, axis=0)) == 0.0
    few = np.zeros_like(a)
    few[0, :4] = True
    assert pixels.overlap(few, few) == 0.0


def test_template_clips_its_box_and_needs_ten_pixels():
    mask = np.zeros((8, 40), dtype=bool)
    mask[2:6, 4:36] = True
    t = pixels.Template.cut(mask, (-5, -5, 400, 400))
    assert t.box == (0, 0, 40, 8)
    assert t.valid
    assert t.score(mask) == 1.0
    assert t.score(mask, prefix=True) == 1.0
    assert t.score(mask[:, :30]) == 0.0
    assert not pixels.Template.cut(mask, (0, 0, 5, 3)).valid


def test_change_ratio_and_packing():
    a = np.zeros((3, 5), dtype=bool)
    b = a.copy()
    b[0, :3] = True
    assert pixels.change_ratio(None, a) == 1.0
    assert pixels.change_ratio(a, a) == 0.0
    assert pixels.change_ratio(a, b) == 1.0
    assert (pixels.unpack_mask(pixels.pack_mask(b), 3, 5) == b).all()


def test_canny_finds_the_border_of_a_square():
    image = np.zeros((20, 20), dtype=np.uint8)
    image[6:14, 6:14] = 255
    found = pixels.canny(image)
    assert found[5:15, 5:15].any()
    assert not found[8:12, 8:12].any()
    assert not pixels.canny(np.full((9, 9), 7, dtype=np.uint8)).any()


def test_correlation_finds_a_shifted_template():
    rng = np.random.default_rng(1)
    frame = (rng.random((20, 40)) > 0.5).astype(np.uint8) * 255
    part = frame[5:12, 9:21]
    assert pixels.correlate(frame, part, np.ones_like(part)) > 0.999
    assert pixels.matches_template(frame, [(part, np.ones_like(part))])
    assert not pixels.matches_template(np.zeros_like(frame), [(part, np.ones_like(part))])


def test_outlined_glyphs_are_filled():
    image = np.full((12, 12), 200, dtype=np.uint8)
    image[3:9, 3:9] = 0
    image[5:7, 5:7] = 250
    out = pixels.outlined_text(image)
    assert (out[5:7, 5:7] == 0).all()
    assert (out[0] == 255).all()


def test_roi_bounds():
    assert pixels.roi_bounds((0.1, 0.2, 0.9, 0.8), 101, 50) == (10, 10, 90, 40)
    with pytest.raises(ValueError):
        pixels.roi_bounds((0.0, 0.0, 0.01, 1.0), 100, 50)
