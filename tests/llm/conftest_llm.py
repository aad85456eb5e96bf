"""Helpers of the brute-force versions."""

import re
import string


def lower_ascii(s):
    return s.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def order(i):
    return 2**63 - 1 if i is None else i


def words(text):
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]
