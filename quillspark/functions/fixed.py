"""What must be as it is for right results, in one place and in plain form. No logic."""

from __future__ import annotations

#: Variant characters and the ones used in their place.
VARIANTS = {"溼": "濕", "芪": "耆", "痹": "痺", "谿": "溪"}
#: Characters that carry no search meaning in a pair.
PARTICLES = "的了吗呢啊吧呀么什"
#: Numerals of headings.
NUMERALS = "一二三四五六七八九十百千零〇两兩"
#: First-level headings, second-level headings; a line over forty characters is none.
HEADINGS_1 = [
    rf"^第[{NUMERALS}\d]+[章講讲節节篇回課课卷部]",
    rf"^[^，,。：:；]{{2,20}}第[{NUMERALS}\d]+$",
    "^辨.{1,16}[病脉脈].{0,10}[治篇法]",
    "^[壹貳贰參叁肆伍陸陆柒捌玖拾]+[、．.]",
    "^【(?![^】]*(?:社|報|报|網|网|新聞|新闻|記者|记者|電|电))[^】]{1,30}】$",
]
HEADINGS_2 = [rf"^[{NUMERALS}]{{1,4}}\s*[、．.：:]\s*\S", r"^[（(][一二三四五六七八九十\d]{1,3}[)）]\s*\S", r"^\d{1,3}\s*[、．.]\s*[^\d\s]"]
#: Dates in order of trust: the pattern and which of its groups are year, month and day (0: none).
DATES = [
    (r"(?<!\d)((?:19|20)\d{2})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})(?!\d)", (1, 2, 3)),
    (r"(?<!\d)(\d{1,2})/(\d{1,2})/((?:19|20)\d{2})(?!\d)", (3, 1, 2)),
    (r"(?<!\d)((?:19|20)\d{2})(\d{2})(\d{2})(?!\d)", (1, 2, 3)),
    (r"(?<!\d)((?:19|20)\d{2})\s*年\s*(\d{1,2})\s*月", (1, 2, 0)),
]
#: A sentence with its end marks.
SENTENCE = "[^。！？；!?;\\n]*[。！？；!?;\\n]+|[^。！？；!?;\\n]+$"
#: A line that is a page mark.
PAGE_MARK = r"(?i)^(?:第?\s*\d*\s*[页頁]|P\s*\d+\s*-\s*\d[\d ]*|[IVXLC]+|\d+|[-–—\s\d]+)$"
#: Eight digits that are a date in a title; words before it that are no name.
TITLE_DATE = r"(?<!\d)((?:19|20)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?!\d)"
#: What may follow it: the end of a span of dates, the number of a visit; what is trimmed off a name and a complaint.
TITLE_SPAN = r"^\s*[~～]\s*(?:19|20)\d{6}"
TITLE_VISIT = r"^[\s_\-－]*(?:\d{1,2}[_\-－])?"
TITLE_EDGE = r"^[ _\-－,，]+|[ _\-－,，]+$"
NO_NAMES = ("醫案", "医案", "病案", "病例", "病患", "診療", "诊疗", "日誌", "日志")
#: A time code in a section; an article of a section: its number and its text.
TIME_CODE = r"\s*[（(]\s*\d+\s*[-－]\s*\d{1,2}:\d{2}:\d{2}\s*[）)]"
ARTICLE = r"(?:^|\s)((?:[一二三四五六七八九十百〇零]{1,5}|\d{1,3})[：:])\s*(\S.*)$"
#: Brackets that a section may hold by halves.
BRACKETS = "【】[]（）()"
#: A numbered line of a lecture: the number and the text.
NUMBERED = r"(?m)^\s*([一二三四五六七八九十百千〇零兩两\d]{1,7})\s*[、：:]\s*[「\"“]?(.{8,})$"
#: Fillers of speech that scoring leaves out; those that don't count as spoken in a correction.
FILLERS = "嗯啊哈呃哦欸誒诶喔唉噢"
SPOKEN_FILLERS = "嗯啊哈呃哦噢唉欸呀耶"
#: What symbol fonts leave in the private use area, and what it is.
SYMBOLS = {"\uf0e0": "→", "\uf0e8": "⇒", "\uf0df": "←", "\uf04a": "☺", "\uf0b2": "•"}
#: A glossary of pronunciations begins with the name of a chapter; an entry of it.
GLOSS_HEAD = "^(?:序|[\u3400-\u9fff]{1,12}(?:論|篇))："
GLOSS_ENTRY = "（[^）]*(?:切|音)[^）]*）"
