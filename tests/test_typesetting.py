"""Line splitting keeps every character and every cluster."""

from cuewright.functions import typesetting as ty


def test_parts_fit_and_keep_the_text():
    text = "A rather long sentence that needs two cues, because it cannot be wrapped into only two lines of forty-two characters, and so on"
    found = ty.parts(text)
    assert len(found) > 1 and all(ty.fits(p, 42) for p in found) and " ".join(found).split() == text.split()
    assert ty.parts("short") == ["short"] and ty.parts("x" * 200) is None


def test_clusters_stay_whole():
    assert ty.slices("กำกำ", 2) == ["กำ", "กำ"] and "".join(ty.slices("สวัสดีครับ", 3)) == "สวัสดีครับ"
    assert all(not s.startswith("ั") for s in ty.slices("สวัสดีครับ", 3)) and ty.slices("เก", 1) == ["เก"] and ty.slices("กเกก", 2) == ["ก", "เก", "ก"]


def test_greedy_lines():
    assert ty.lines("one two three", 7) == ["one two", "three"] and ty.lines("abcdef", 4) == ["abcd", "ef"]
