"""Legacy charmaps and their application as column expressions.

The three maps whose sources are single characters become one ``translate``, which is the greedy
scan itself; VNI, whose sources are pairs that no output can form, becomes a chain of ``replace``.
TCVN3 and VNI are partial and lower case only, as far as they are certain.
"""

from __future__ import annotations

from functools import reduce
from types import MappingProxyType

from pyspark.sql import Column
from pyspark.sql import functions as F

_TCVN3 = "µ=à ¸=á ¶=ả ·=ã ¹=ạ ¨=ă »=ằ ¾=ắ ¼=ẳ ½=ẵ Æ=ặ ®=đ"
_VNI = "a½=à aù=á aû=ả aõ=ã aï=ạ ñ=đ"
_VISCII = (
    "02:1EB2 05:1EB4 06:1EAA 14:1EF6 19:1EF8 1E:1EF4 80:1EA0 81:1EAE 82:1EB0 83:1EB6 84:1EA4 85:1EA6 86:1EA8 87:1EAC 88:1EBC 89:1EB8 "
    "8A:1EBE 8B:1EC0 8C:1EC2 8D:1EC4 8E:1EC6 8F:1ED0 90:1ED2 91:1ED4 92:1ED6 93:1ED8 94:1EE2 95:1EDA 96:1EDC 97:1EDE 98:1ECA 99:1ECE "
    "9A:1ECC 9B:1EC8 9C:1EE6 9D:0168 9E:1EE4 9F:1EF2 A0:00D5 A1:1EAF A2:1EB1 A3:1EB7 A4:1EA5 A5:1EA7 A6:1EA9 A7:1EAD A8:1EBD A9:1EB9 "
    "AA:1EBF AB:1EC1 AC:1EC3 AD:1EC5 AE:1EC7 AF:1ED1 B0:1ED3 B1:1ED5 B2:1ED7 B3:1EE0 B4:01A0 B5:1ED9 B6:1EDD B7:1EDF B8:1ECB B9:1EF0 "
    "BA:1EE8 BB:1EEA BC:1EEC BD:01A1 BE:1EDB BF:01AF C4:1EA2 C5:0102 C6:1EB3 C7:1EB5 CB:1EBA CE:0128 CF:1EF3 D0:0110 D1:1EE9 D5:1EA1 "
    "D6:1EF7 D7:1EEB D8:1EED DB:1EF9 DC:1EF5 DE:1EE1 DF:01B0 E4:1EA3 E5:0103 E6:1EEF E7:1EAB EB:1EBB EE:0129 EF:1EC9 F0:0111 F1:1EF1 "
    "F6:1ECF F7:1ECD F8:1EE5 FB:0169 FC:1EE7 FE:1EE3 FF:1EEE "
)
_VPS = (
    "02:1EA0 03:1EAC 04:1EB6 05:1EB8 06:1EC6 10:1ECA 11:1ECC 12:1ED8 13:1EE2 14:1EE4 15:1EF0 19:1EF4 1C:1EAA 1D:1EEE 80:00C0 81:1EA2 "
    "82:00C3 83:1EA4 84:1EA6 85:1EA8 86:1ECD 87:1ED7 88:0102 89:1EBF 8A:1EC1 8B:1EC3 8C:1EC7 8D:1EAE 8E:1EB0 8F:1EB2 90:1EBE 93:1EC0 "
    "94:1EC2 95:1EC4 96:1ED0 97:1ED2 98:1ED4 99:1ED6 9A:00FD 9B:1EF7 9C:1EF5 9D:1EDA 9E:1EDC 9F:1EDE A1:1EAF A2:1EB1 A3:1EB3 A4:1EB5 "
    "A5:1EB7 A6:1EE0 A7:1EDB A8:00D9 A9:1EDD AA:1EDF AB:1EE1 AC:0168 AD:1EE8 AE:1EE3 AF:1EEA B0:1ED5 B1:1EEC B2:1EF2 B3:1EF8 B4:00CD "
    "B5:00CC B6:1ED9 B7:1EC8 B8:0128 B9:00D3 BA:1EED BB:1EEF BC:00D2 BD:1ECE BE:00D5 BF:1EF1 C0:1EA7 C3:1EA5 C4:1EA9 C5:1EAB C6:1EAD "
    "C7:0111 C8:1EBB CB:1EB9 CC:1EC9 CD:1EC5 CE:1ECB CF:1EF9 D0:01AF D1:1EE6 D2:1ED3 D3:1ED1 D5:1ECF D6:01A1 D7:00C8 D8:1EEB D9:1EE9 "
    "DB:0169 DC:01B0 DE:1EBA E4:1EA3 E5:1EA1 E6:0103 EB:1EBD EF:0129 F0:1EB4 F1:0110 F7:01A0 F8:1EE5 FB:1EE7 FD:1EF6 FE:1EBC FF:1EF3 "
)


def build(pairs: list[tuple[str, str]]) -> tuple[tuple[str, str], ...]:
    """Validated pairs, the longest sources first."""
    sources = [a for a, _ in pairs]
    if not all(a and b for a, b in pairs):
        raise ValueError("a charmap entry has an empty side")
    if len(set(sources)) < len(sources):
        raise ValueError("a charmap has a source twice")
    return tuple(sorted(pairs, key=lambda p: -len(p[0])))


def _words(text: str) -> list[tuple[str, str]]:
    return [(a, b) for a, _, b in (x.partition("=") for x in text.split())]


def _codes(text: str) -> list[tuple[str, str]]:
    return [(chr(int(a, 16)), chr(int(b, 16))) for a, b in (x.split(":") for x in text.split())]


CHARMAPS = MappingProxyType({"tcvn3": build(_words(_TCVN3)), "vni": build(_words(_VNI)), "viscii": build(_codes(_VISCII)), "vps": build(_codes(_VPS))})
#: VPS overlaps ordinary Latin text too much to be tried unasked.
AUTO_DETECT = ("tcvn3", "viscii", "vni")


def apply(text: Column, encoding: str | None) -> Column:
    """The text converted by a charmap, without normalising; unchanged if there is none of that name."""
    pairs = CHARMAPS.get(encoding or "")
    if not pairs:
        return text
    if all(len(a) == 1 and len(b) == 1 for a, b in pairs):
        return F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def convert(text: str, encoding: str) -> str:
    """The greedy scan on a Python string, for tests and driver-side use; not normalised."""
    pairs, out, i = CHARMAPS[encoding], [], 0
    while i < len(text):
        for a, b in pairs:
            if text.startswith(a, i):
                out.append(b)
                i += len(a)
                break
        else:
            out.append(text[i])
            i += 1
    return "".join(out)
