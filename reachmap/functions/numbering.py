"""The numbering plan: which national numbers exist in which region.

Rows approximate the public national numbering plans: in detail for the regions a top-level
domain suggests, by leading digits and length for the others. Callers can pass their own, fuller rows
to the phone expressions; the list is code-sized configuration, never data that grows. The detailed
rows must accept what the public phone metadata of libphonenumber (Apache License 2.0) accepts, and are
fixed values for that reason; the others are coarser.
"""

from __future__ import annotations

from typing import NamedTuple


class Region(NamedTuple):
    """One region of the plan; regions that share a calling code are tried in list order."""

    region: str
    calling_code: str
    pattern: str  # national significant number
    trunk: str = ""  # prefix dialled before national numbers
    trunk_required: bool = False  # local numbers in running text must carry the prefix
    idd: str = "00"  # prefix dialled before international numbers


# Area codes of the United States and Canada.
_US_AREAS = (
    "2(?:0[1-35-9]|1[02-9]|2[03-57-9]|3[1459]|4[08]|5[1-46]|6[0279]|7[0269]|8[13])"
    "|3(?:0[1-57-9]|1[02-9]|2[013-79]|3[0-24679]|4[167]|5[0-3]|6[01349]|8[056])"
    "|4(?:0[124-9]|1[02-579]|2[3-5]|3[0245]|4[023578]|58|6[349]|7[0589]|8[04])"
    "|5(?:0[1-57-9]|1[0235-8]|20|3[0149]|4[01]|5[179]|6[1-47]|7[0-5]|8[0256])"
    "|6(?:0[1-35-9]|1[024-9]|2[03689]|3[016]|4[0156]|5[01679]|6[0-279]|78|8[0-269])"
    "|7(?:0[1-46-8]|1[2-9]|2[04-8]|3[0-247]|4[037]|5[47]|6[02359]|7[0-59]|8[156])"
    "|8(?:0[1-68]|1[02-8]|2[0168]|3[0-2589]|4[03578]|5[046-9]|6[02-5]|7[028])"
    "|9(?:0[1346-9]|1[02-9]|2[0589]|3[0146-8]|4[01357-9]|5[12469]|7[0-3589]|8[04-69])"
)
_CA_AREAS = (
    "2(?:04|[23]6|[48]9|50|63)|3(?:06|43|54|6[578]|82)|4(?:03|1[68]|[26]8|3[178]|50|74)"
    "|5(?:06|1[49]|48|79|8[147])|6(?:04|[18]3|39|47|72)|7(?:0[59]|42|53|78|8[02])"
    "|8(?:[06]7|19|25|7[39])|9(?:0[25]|42)"
)
_TOLL_FREE = "8(?:00|33|44|55|66|77|88)|900"

# The numbering plan.
NUMBERING_PLAN = (
    Region("US", "1", f"(?:{_US_AREAS}|{_TOLL_FREE})[2-9]\\d{{6}}", "1", idd="011"),
    Region("CA", "1", f"(?:{_CA_AREAS})[2-9]\\d{{6}}", "1", idd="011"),
    Region("KZ", "7", r"33622\d{5}|7(?:1[0-8]|2[1-9])\d{7}|7(?:0[0-25-8]|47|6[0-4]|7[15-8]|85)\d{7}", "8", idd="810"),
    Region(
        "RU", "7",
        r"(?:3(?:0[12]|36|4[1-35-79]|5[1-3]|65|8[1-58]|9[0145])|4(?:01|1[1356]|2[13467]|7[1-5]|8[1-7]|9[1-689])"
        r"|8(?:1[1-8]|2[01]|3[13-6]|4[0-8]|5[15-7]|6[0-35-79]|7[1-37-9])|9\d{2}|80[03489])\d{7}",
        "8", idd="810",
    ),
    Region("BY", "375", r"(?:1(?:5[1-7]|6[2-5]|7[1-47-9])|2(?:1[1-7]|2[1-5]|3[1-6]))\d{6}|(?:2(?:5[5-79]|9[1-9])|33\d|44\d)\d{6}|80[01]\d{7}", "8", True, "810"),
    Region("UA", "380", r"(?:3[1-8]|4[13-8]|5[1-7]|6[12459])\d{7}|(?:39|50|6[36-8]|7[1-357]|9[1-9])\d{7}|800\d{6}", "0", True),
    Region("KG", "996", r"3(?:1(?:[256]\d|3[1-9]|47)|2(?:22|3[0-479]|6[0-7])|4(?:22|5[6-9]|6\d)|5(?:22|3[4-7]|59|6\d)|6(?:22|5[35-7]|6\d)|7(?:22|3[468]|4[1-9]|59|[67]\d)|9(?:22|4[1-8]|6\d))\d{5}|(?:2(?:0[0-35]|2\d)|5[0-24-7]\d|600|7(?:[07]\d|55)|88[08]|99[05-9])\d{6}", "0", True),
    Region("UZ", "998", r"(?:33|50|55|6[1257-9]|7[0-9]|88|9[0-57-9])\d{7}", "8", idd="810"),
    Region("AM", "374", r"(?:1[0-25]|47)\d{6}|(?:2(?:2[2-46]|3[1-8]|4[2-69]|5[2-7]|6[1-9]|8[1-7])|3[12]2)\d{5}|(?:33|4[1349]|55|77|88|9[13-9])\d{6}|800\d{5}", "0", True),
    Region("AZ", "994", r"(?:1[28]|2[0-25]|36)\d{7}|(?:4[04]|5[015]|60|7[07]|99|10)\d{7}", "0", True),
    Region("GE", "995", r"(?:3(?:[256]\d|4[124-9]|7[0-4])|4(?:1\d|2[2-7]|3[1-79]|4[2-8]|7[239]|9[1-7]))\d{6}|5\d{8}|7[0-9]\d{7}|800\d{6}", "0"),
    Region("MD", "373", r"(?:(?:2[1-9]|3[1-79])\d|5(?:33|5[257]))\d{5}|(?:6\d|7[1-9])\d{6}|800\d{5}", "0", True),
    Region("EE", "372", r"(?:3[23589]|4[3-8]|6\d|7[1-9]|88)\d{5}|(?:5\d|8[1-4])\d{5,6}|800\d{4,7}"),
    Region("LV", "371", r"(?:6\d|2\d|8[01]|90)\d{6}"),
    Region("LT", "370", r"(?:3[1478]|4[124-6]|52)\d{6}|6\d{7}|80[02]\d{5}", "[08]", True),
    Region("PL", "48", r"(?:1[2-8]|2[2-69]|3[2-4]|4[1-468]|5[24-689]|6[1-3578]|7[14-7]|8[1-79]|9[145])\d{7}|(?:21|45|5[0137]|6[069]|7[2389]|88)\d{7}|800\d{6}"),
    Region("DE", "49", r"(?:2(?:0[1-689]|[1-3569]\d|4[0-8]|7[1-7]|8[0-7])|3(?:[3569]\d|4[0-79]|7[1-7]|8[1-8])|4(?:1[02-9]|[2-48]\d|5[0-6]|6[0-8]|7[0-79])|5(?:0[2-8]|[124-6]\d|[38][0-8]|[79][0-7])|6(?:0[02-9]|[1-358]\d|[47][0-8]|6[1-9])|7(?:0[2-8]|1[1-9]|[27][0-7]|3\d|[4-6][0-8]|8[0-5]|9[013-7])|8(?:0[2-9]|1[0-79]|2\d|3[0-46-9]|4[0-6]|5[013-9]|6[1-8]|7[0-8]|8[0-24-6])|9(?:0[6-9]|[1-4]\d|[589][0-7]|6[0-8]|7[0-467]))\d{3,8}|(?:30|40|69|89)\d{5,8}|1(?:5[0-25-9]\d{8}|6[023]\d{7,8}|7\d{8,9})|800\d{7}", "0", True),
    Region("FR", "33", r"(?:26[0-9]|[1-35]\d\d|4[0-9]\d)\d{6}|(?:6(?:[0-24-8]\d|3[0-8]|9[589])|7[3-9]\d)\d{6}|80[0-5]\d{6}|9\d{8}|8[129]\d{7}", "0", True),
    Region("IT", "39", r"0(?:[26]\d{4,9}|(?:1[0-9]|3[0-9]|4[0-9]|5[0-9]|7[0-9]|8[0-9]|9[0-9])\d{4,8})|3[1-9]\d{7,8}|80(?:0\d{3}|3)\d{3}"),
    Region("ES", "34", r"(?:96906(?:0[0-8]|1[1-9]|[2-9]\d)\d\d|9(?:69(?:0[0-57-9]|[1-9]\d)|73(?:[0-8]\d|9[1-9]))\d{4}|(?:8(?:[1356]\d|[28][0-8]|[47][1-9])|9(?:[135]\d|[268][0-8]|4[1-9]|7[124-9]))\d{6})|(?:6\d|7[1-48])\d{7}|[89]00\d{6}|90[12]\d{6}"),
    Region("PT", "351", r"2(?:[12]\d|3[1-689]|4[1-59]|[57][1-9]|6[1-35689]|8[1-69]|9[1256])\d{6}|9[1-36]\d{7}|80[02]\d{6}|30\d{7}"),
    Region("NL", "31", r"(?:1(?:[035]\d|1[13-578]|6[124-8]|7[24]|8[0-467])|2(?:[0346]\d|2[2-46-9]|5[125]|9[479])|3(?:[03568]\d|1[3-8]|2[01]|4[1-8])|4(?:[0356]\d|1[1-368]|7[58]|8[15-8]|9[23579])|5(?:[0358]\d|[19][1-9]|2[1-57-9]|4[13-8]|6[126]|7[0-3578])|7\d\d)\d{6}|6[1-58]\d{7}|800\d{4,7}|90[069]\d{4,7}|8[58]\d{7}", "0", True),
    Region("BE", "32", r"80[2-8]\d{5}|(?:1[0-69]|[23][2-8]|4[23]|5\d|6[013-57-9]|71|8[1-79]|9[2-4])\d{6}|4[5-9]\d{7}|800[1-9]\d{4}", "0", True),
    Region("CH", "41", r"(?:2[12467]|3[1-4]|4[134]|5[256]|6[12]|[7-9]1)\d{7}|7[35-9]\d{7}|800\d{6}|58\d{7}", "0", True),
    Region("AT", "43", r"1(?:11\d|[2-9]\d{3,11})|(?:316|463)\d{3,10}|(?:2(?:1[467]|2[13-8]|5[2357]|6[1-46-8]|7[1-8]|8[124-7]|9[1458])|3(?:1[1-578]|3[23568]|4[5-7]|5[1378]|6[1-38]|8[3-68])|4(?:2[1-8]|35|7[1368]|8[2457])|5(?:2[1-8]|3[357]|4[147]|5[12578]|6[37])|6(?:13|2[1-47]|4[135-8]|5[468])|7(?:2[1-8]|35|4[13478]|5[68]|6[16-8]|7[1-6]|9[45]))\d{4,10}|51[2-9]\d{3,10}|6(?:5[0-3579]|6[013-9]|[7-9]\d)\d{4,10}|800\d{6,10}", "0", True),
    Region("SE", "46", r"(?:(?:[12][136]|3[356]|4[0246]|6[03]|8\d)\d|90[1-9])\d{4,6}|(?:1(?:2[0-35]|4[0-4]|5[0-25-9]|7[13-6]|[89]\d)|2(?:2[0-7]|4[0136-8]|5[0138]|7[018]|8[01]|9[0-57])|3(?:0[0-4]|1\d|2[0-25]|4[056]|7[0-2]|8[0-3]|9[023])|4(?:1[013-8]|3[0135]|5[14-79]|7[0-246-9]|8[0156]|9[0-689])|5(?:0[0-6]|[15][0-5]|2[0-68]|3[0-4]|4\d|6[03-5]|7[013]|8[0-79]|9[01])|6(?:1[1-3]|2[0-4]|4[02-57]|5[0-37]|6[0-3]|7[0-2]|8[0247]|9[0-356])|9(?:1[0-68]|2\d|3[02-5]|4[0-3]|5[0-4]|[68][01]|7[0135-8]))\d{5,6}|7[02369]\d{7}|20\d{4,7}", "0", True),
    Region("NO", "47", r"(?:2[1-4]|3[1-3578]|5[1-35-7]|6[1-4679]|7[0-8])\d{6}|(?:4[015-8]|59|9\d)\d{6}|80[01]\d{5}|0[2-9]\d{3}"),
    Region("FI", "358", r"(?:1[3-79][1-8]|[235689][1-8]\d)\d{2,6}|(?:4[0-8]|50)\d{4,8}|800\d{4,6}", "0", True),
    Region("DK", "45", r"(?:[2-7]\d|8[126-9]|9[1-46-9])\d{6}|80\d{6}"),
    Region("IE", "353", r"(?:1\d|21)\d{6,7}|(?:2[24-9]|4(?:0[24]|5\d|7)|5(?:0[45]|1\d|8)|6(?:1\d|[237-9])|9(?:1\d|[35-9]))\d{5}|(?:23|4(?:[1-469]|8\d)|5[23679]|6[4-6]|7[14]|9[04])\d{7}|8(?:22|[35-9]\d)\d{6}|1800\d{6}", "0", True),
    Region("GB", "44", r"(?:2(?:0(?:[0-258]\d|3[0-9]|4[56]|7[0-9])|3(?:[0189]\d)|4(?:7|[0-9])\d|8(?:[0-9]\d)|9(?:[0-9]\d))\d{6}|1(?:1[3-8]\d|21\d|31\d|41\d|51\d|61\d|91\d)\d{6}|1(?:2(?:0[024-9]|2[3-9]|3[3-79]|4[1-689]|[58][02-9]|6[0-47-9]|7[013-9]|9\d)|3(?:0\d|[25][02-9]|3[02-579]|[468][0-46-9]|7[1-35-79]|9[2-578])|4(?:0[03-9]|[137]\d|[28][02-57-9]|4[02-69]|5[0-8]|[69][0-79])|5(?:0[1-35-9]|2[024-9]|3[015689]|4[02-9]|5[03-9]|6\d|7[0-35-9]|8[0-468]|9[0-57-9])|6(?:0[034689]|2\d|3[0-8]|4[013-9]|5[02-9]|6\d|7[0-8]|8[0-24578])|7(?:0[0246-9]|2\d|3[0236-8]|4[03-9]|5[0-46-9]|6[013-9]|7[0-35-9]|8[024-9]|9[02-9])|8(?:0[35-9]|2[1-57-9]|3[02-578]|4[0-578]|5[124-9]|6[2-69]|7\d|8[02-9]|9[02569])|9(?:0[02-589]|2[02-689]|3[1-57-9]|4[2-9]|5[0-579]|6[2-47-9]|7[0-24578]|8\d|9[2-57]))\d{6})|7(?:[1-57-9]\d{2}|624)\d{6}|80(?:0\d{6,7}|8\d{7})|8(?:4[3-5]|7[0-3])\d{7}|3[0347]\d{8}|56\d{8}", "0", True),
    Region("AU", "61", r"(?:[2378]\d|4[0-9])\d{7}|1800\d{6}|13(?:00\d{6}|\d{4})|550\d{6}", "0", idd="0011"),
    Region("NZ", "64", r"(?:3[2-79]|[49][2-9]|6[235-9]|7[2-57-9])\d{6}|2(?:[0-27-9]\d|6)\d{6,7}|508\d{6,7}|80\d{6,8}", "0", True),
    Region("JP", "81", r"(?:1[1-9]|2[2-6]|3[1-9]|4[2-9]|5[2-8]|6[1-9]|7[2-9]|8[2-9]|9[2-9])\d{7}|[7-9]0[1-9]\d{7}|50[1-9]\d{7}|120\d{6}|800\d{7}", "0", True, "010"),
    Region("CN", "86", r"(?:10|2[0-57-9])\d{8}|(?:3(?:1[0-9]|35|7[0-9]|9[1-8])|4(?:1[0-9]|2[179]|3[3-5]|5[1-9]|6[4-9]|7[0-9]|8[23])|5(?:[13]\d|2[37]|4[36]|5\d|6[1-6]|7[0-9]|80|9[1-6])|6(?:3[1-5]|6[0-9]|9[12])|7(?:01|[17]\d|2[248]|3[014-9]|4[3-6]|5[0-9]|6[023689]|9[0-9])|8(?:1[236-8]|2[5-7]|3\d|5[1-9]|7[02-9]|8[36-8]|9[1-7])|9(?:0[1-3689]|1[1-79]|3\d|4[13]|5[1-5]|7[0-79]|9[0-35-9]))\d{7,8}|1[3-9]\d{9}|800\d{7}|400\d{7}", "0"),
    Region("IN", "91", r"[6-9]\d{9}|(?:11|2[02]|33|4[04]|79|80)[2-7]\d{7}|(?:1[2-9]|2[1-9]|3[1-9]|4[1-9]|5[1-9]|6[1-9]|7[1-8]|8[1-9])\d[2-7]\d{6}|1800\d{4,8}", "0"),
    # Regions no top-level domain above suggests: their numbers are met with "+" or by choice.
    Region("DO", "1", r"8(?:[04]9|29)[2-9]\d{6}", "1", idd="011"),
    Region("PR", "1", r"(?:787|939)[2-9]\d{6}", "1", idd="011"),
    Region("JM", "1", r"(?:658|876)[2-9]\d{6}", "1", idd="011"),
    Region("TT", "1", r"868[2-9]\d{6}", "1", idd="011"),
    Region("BS", "1", r"242[2-9]\d{6}", "1", idd="011"),
    Region("BB", "1", r"246[2-9]\d{6}", "1", idd="011"),
    Region("BM", "1", r"441[2-9]\d{6}", "1", idd="011"),
    Region("KY", "1", r"345[2-9]\d{6}", "1", idd="011"),
    Region("EG", "20", r"1[0-25]\d{8}|(?:2\d|3)\d{7}|[4-9]\d{7,8}", "0"),
    Region("MA", "212", r"[5-8]\d{8}", "0"),
    Region("DZ", "213", r"[5-7]\d{8}|[1-4]\d{7}", "0"),
    Region("TN", "216", r"[2-57-9]\d{7}"),
    Region("NG", "234", r"[7-9][01]\d{8}|[1-9]\d{6,7}", "0"),
    Region("GH", "233", r"[235]\d{8}", "0"),
    Region("KE", "254", r"(?:7\d\d|1[01]\d)\d{6}|[2-6]\d{5,8}", "0"),
    Region("ZA", "27", r"[1-8]\d{8}", "0"),
    Region("GR", "30", r"2\d{9}|69\d{8}|800\d{7}"),
    Region("HU", "36", r"(?:[2357]0|31)\d{7}|[1-9]\d{7}"),
    Region("LU", "352", r"6[2689]1\d{6}|[2-9]\d{5,10}"),
    Region("IS", "354", r"[4-8]\d{6}"),
    Region("AL", "355", r"6[6-9]\d{7}|[2-58]\d{6,7}", "0"),
    Region("MT", "356", r"[279]\d{7}"),
    Region("CY", "357", r"[29]\d{7}"),
    Region("BG", "359", r"8[789]\d{7}|[2-9]\d{6,7}", "0"),
    Region("TJ", "992", r"[0-57-9]\d{8}"),
    Region("TM", "993", r"6[1-9]\d{6}|[1-5]\d{7}", "8", idd="810"),
    Region("RS", "381", r"6\d{7,8}|[1-3]\d{7,8}", "0"),
    Region("ME", "382", r"[2-6]\d{7}", "0"),
    Region("HR", "385", r"9[1-9]\d{6,7}|[1-5]\d{7}", "0"),
    Region("SI", "386", r"[1-7]\d{7}", "0"),
    Region("BA", "387", r"6\d{7,8}|[3-5]\d{7}", "0"),
    Region("MK", "389", r"[237]\d{7}", "0"),
    Region("RO", "40", r"[237]\d{8}|80[01]\d{6}", "0"),
    Region("CZ", "420", r"[2-9]\d{8}"),
    Region("SK", "421", r"[2-59]\d{8}", "0"),
    Region("PE", "51", r"9\d{8}|1\d{7}|[4-8]\d{7}", "0"),
    Region("MX", "52", r"[2-9]\d{9}"),
    Region("AR", "54", r"9?(?:11\d{8}|[23]\d{9})", "0"),
    Region("BR", "55", r"(?:[14689][1-9]|2[12478]|3[1-578]|5[13-5]|7[13-579])(?:9\d{8}|[2-5]\d{7})|800\d{6,7}", "0"),
    Region("CL", "56", r"[2-79]\d{8}"),
    Region("CO", "57", r"3\d{9}|60[1-8]\d{7}"),
    Region("VE", "58", r"(?:2\d\d|4(?:1[24-8]|2[46]))\d{7}", "0"),
    Region("BO", "591", r"[2-467]\d{7}"),
    Region("EC", "593", r"9\d{8}|[2-7]\d{7}", "0"),
    Region("PY", "595", r"9\d{8}|[2-8]\d{6,8}", "0"),
    Region("UY", "598", r"[249]\d{7}", "0"),
    Region("GT", "502", r"[2-7]\d{7}"),
    Region("CR", "506", r"[24-8]\d{7}"),
    Region("PA", "507", r"6\d{7}|[2-9]\d{6}"),
    Region("MY", "60", r"1\d{8,9}|[3-9]\d{7,8}", "0"),
    Region("ID", "62", r"8\d{8,11}|[2-79]\d{6,10}", "0"),
    Region("PH", "63", r"9\d{9}|[2-8]\d{7,9}", "0"),
    Region("SG", "65", r"[3689]\d{7}|1800\d{7}"),
    Region("TH", "66", r"[689]\d{8}|[2-7]\d{7}", "0"),
    Region("KR", "82", r"1\d{8,9}|2\d{7,8}|[3-6][1-5]\d{6,8}|70\d{8}", "0"),
    Region("VN", "84", r"[35789]\d{8}|2\d{9}", "0"),
    Region("HK", "852", r"[235-9]\d{7}"),
    Region("MO", "853", r"[268]\d{7}"),
    Region("KH", "855", r"[1-9]\d{7,8}", "0"),
    Region("BD", "880", r"1[3-9]\d{8}|[2-9]\d{5,9}", "0"),
    Region("TW", "886", r"9\d{8}|[2-8]\d{7,8}", "0"),
    Region("TR", "90", r"[2-5]\d{9}|800\d{7}", "0"),
    Region("PK", "92", r"3\d{9}|[2-9]\d{8,9}", "0"),
    Region("LK", "94", r"[1-9]\d{8}", "0"),
    Region("IR", "98", r"[1-9]\d{9}", "0"),
    Region("LB", "961", r"[1-9]\d{6}|[378]\d{7}", "0"),
    Region("JO", "962", r"7[789]\d{7}|[2356]\d{7}", "0"),
    Region("IQ", "964", r"7\d{9}|[1-6]\d{7,8}", "0"),
    Region("KW", "965", r"[2569]\d{7}|1\d{6}"),
    Region("SA", "966", r"1[1-7]\d{7}|5\d{8}|920\d{6}|800\d{7}", "0"),
    Region("OM", "968", r"[279]\d{7}"),
    Region("AE", "971", r"[2-4679]\d{7}|5[024-68]\d{7}|800\d{2,9}", "0"),
    Region("IL", "972", r"[2-489]\d{7}|[57]\d{8}", "0"),
    Region("BH", "973", r"[136]\d{7}"),
    Region("QA", "974", r"[3-7]\d{7}"),
    Region("MN", "976", r"[5-9]\d{7}"),
    Region("NP", "977", r"9[678]\d{8}|[1-9]\d{6,7}", "0"),
)
