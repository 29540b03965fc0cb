"""Common words per language (fixed values, a parameter of the operators that use them)."""

from __future__ import annotations

COMMON_WORDS = {
    "en": "a an and are as at be by for from has have he in is it its not of on or she that the their they this to was were which will with you".split(),
    "de": "als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer es für im in ist mit nach nicht sich sie sind über um und von war wie wird zu zum".split(),
    "fr": "au aux avec ce ces comme dans de des du elle en est et il ils la le les leur mais ne ou par pas plus pour que qui sa se ses son sont sur un une".split(),
    "es": "al como con de del el ella en entre es este la las le lo los más me mi muy no o para pero por que se si sin sobre son su sus también un una y ya".split(),
}
