"""Substitution on a text with ranges against a plain version, matches that touch each other included."""

import random
import re

from phrasewright.functions import normal


def test_sub_keeps_ranges():
    rnd = random.Random(1)
    for _ in range(300):
        text = "".join(rnd.choice("ab😀 ") for _ in range(rnd.randint(0, 25)))
        x, ranges = normal.Aligned(text), normal.Aligned(text).ranges
        new = {"ab": "xyz", "a": "", "bb": "q", " ": None, "😀": "ww"}
        x.sub(re.compile("ab|a|bb| |😀"), lambda m: new[m[0]])
        want, at = [], 0
        for m in re.finditer("ab|a|bb|😀", text):
            want += [*zip(text[at : m.start()], ranges[at : m.start()], strict=True), *((c, normal.merged(ranges[m.start() : m.end()])) for c in new[m[0]])]
            at = m.end()
        want += zip(text[at:], ranges[at:], strict=True)
        assert (x.text, x.ranges) == ("".join(c for c, _ in want), [r for _, r in want])
