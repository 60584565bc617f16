from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.operators.globs import Glob, cover, reaches

PATHS = [f"r{a}{b}" for a in ("", "/a", "/b", "/c") for b in ("", "/x", "/y", "/x/z")]


@settings(max_examples=300, deadline=None)
@given(st.sets(st.sampled_from(PATHS), min_size=1), st.sets(st.sampled_from(PATHS)))
def test_a_cover_reaches_its_own_directories_alone(own, others):
    every = own | others
    globs = cover(own, every, "r")
    for d in every:
        assert reaches(globs, f"{d}/f.js") == (d in own), (globs, d)


def test_shorter_cover_wins():
    every = {"r", *(f"r/{c}" for c in "abcdef")}
    assert cover(every, every, "r") == [Glob("r", True)]
    assert cover(every - {"r/f"}, every, "r") == [Glob("r", True), Glob("r/f", True, True)]
    assert cover({"r/f"}, every, "r") == [Glob("r/f", True)]
    assert Glob("r", True).text(["js", "jsx"]) == "r/**/*.{js,jsx}" and Glob("r", False, True).text(["rb"]) == "!r/*.rb"
