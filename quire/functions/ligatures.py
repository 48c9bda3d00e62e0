"""Repairs of Arabic text taken from PDF files whose fonts map ligatures backwards: rules in order, each a pattern and its replacement."""

from __future__ import annotations

import re

# Code points that calligraphic fonts leave behind; the second set only beside Arabic.
ARTEFACTS = "ĀăąćĊċđĒēĔĕĖĚĩĪĭĮıĳŅŊŋŌōřŚƑƔƕƗƜƝƸƺƻǌǍǕǢȈȝȤ͜͝͞▪\ufffd"
LATIN_ARTEFACTS = "ø÷äöüþúùûóõÿ"
BESIDE = rf"[{LATIN_ARTEFACTS}](?=[\u0600-\u06FF])|(?<=[\u0600-\u06FF])[{LATIN_ARTEFACTS}]"

# Stems of adjectives in -ira.
STEMS = ("كب", "كث", "صغ", "قص", "خط", "مس", "أخ", "اخ", "عس", "وف", "شه", "جز", "بص", "يس")

# Fixed values: (pattern, replacement), in the order in which they apply. Plain words stand for themselves.
RULES = [
    (r"(?<![\u0600-\u06FF])([وف])?يف(?![\u0600-\u06FF])", r"\1في"),
    (r"(?<![\u0600-\u06FF])([وفلكب])?عىل(?![\u0600-\u06FF])", r"\1على"),
    (r"(?<![\u0600-\u06FF])([وفلكب])?إىل(?![\u0600-\u06FF])", r"\1إلى"),
    (r"(?<![\u0600-\u06FF])([وف])?كام(?![\u0600-\u06FF])", r"\1كما"),
    (r"(?<![\u0600-\u06FF])([وف]|ما)?بني(?![\u0600-\u06FF])", r"\1بين"),
    (r"األ", r"الأ"),
    (r"اإل", r"الإ"),
    (r"اآل", r"الآ"),
    (r"(?<![\u0600-\u06FF])([وفلكب]?|[لب]ل)اال", r"\1الا"),
    (r"(?<![\u0600-\u06FF])([وفبك]?|[لب]ل)امل", r"\1الم"),
    (r"(?<![\u0600-\u06FF])([وفبك]?|[لب]ل)اجل", r"\1الج"),
    (r"(?<![\u0600-\u06FF])([وفبك]?|[لب]ل)احل", r"\1الح"),
    (r"(?<![\u0600-\u06FF])([وفبك]?|[لب]ل)اخل", r"\1الخ"),
    (r"(?<![\u0600-\u06FF])([وفبك]?|[لب]ل)اهل(?![\u0600-\u06FF])", r"\1اله"),
    (r"(?<![\u0600-\u06FF])([وفبك]?|[لب]ل)اهل(?!ك)([ء-ي])", r"\1اله\2"),
    (r"([ء-ي]+)ايل\b", r"\1الي"),
    (r"(?<![ء-ي])(الث|والث|اليون|الإنس|الوجـد|المع|ث)اين\b", r"\1اني"),
    (r"([ء-ي]+)ايف\b", r"\1افي"),
    *((rf"(?<![\u0600-\u06FF])((?:ال|وال|فال|بال|كال|و|ف|ب|ل|ك)?){s}رية(?![\u0600-\u06FF])", rf"\1{s}يرة") for s in STEMS),
    (r"جتامع", r"جتماع"),
    (r"ثالثة", r"ثلاثة"),
    (r"الثالثة", r"الثلاثة"),
    (r"تارخي", r"تاريخ"),
    (r"أفالطون", r"أفلاطون"),
    (r"متزج", r"تمزج"),
    (r"أخريا", r"أخيرا"),
    (r"اخريا", r"أخيرا"),
    (r"اإلجيايب", r"الإيجابي"),
    (r"الإجيايب", r"الإيجابي"),
    (r"إجيايب", r"إيجابي"),
    (r"مالحظ", r"ملاحظ"),
    (r"االجحاف", r"الإجحاف"),
    (r"([ء-ي]+)وهلا\b", r"\1ولها"),
    (r"([ء-ي]+)تهام\b", r"\1تهما"),
    (r"(?<![\u0600-\u06FF])([وفلكسي]?|يت)خيت", r"\1يخت"),
    (r"(?<![\u0600-\u06FF])([وفلكسي]?|يت)خيلف", r"\1يخلف"),
    (r"(?<![\u0600-\u06FF])((?:[وفلبك]?(?:ال)?))رضوري", r"\1ضروري"),
    (r"(?<![\u0600-\u06FF])((?:[وفلبك]?(?:ال)?))يشء", r"\1شيء"),
    (r"(?<![\u0600-\u06FF])([وفلكب])?متاما\b", r"\1تماما"),
    (r"(?<![\u0600-\u06FF])((?:[وفلبك]?(?:ال)?))رصح(?![\u0600-\u06FF])", r"\1صرح"),
    (r"\bترشح\b", r"تشرح"),
    (r"\bفرشح\b", r"فشرح"),
    (r"\bحتدد\b", r"تحدد"),
    (r"\bسري\s+(الفكر|التاريخ|الأحداث|المنطق)", r"سير \1"),
    (r"\b([وفب]?)ثالث\s+(زوايا|خطوات|درجات|مراحل|قواعد|أسئلة|عوامل|حقائق|ملاحظات|مالحظات|أقسام|مرات|وسائل|مفكرين|حالات|علامات|أيام|سنين|سنوات)", r"\1ثلاث \2"),
    (f"[{ARTEFACTS}]", ""),
    (BESIDE, ""),
    (r"(?<=[\u0600-\u06FF\s])(?:nj|lj)(?=[\u0600-\u06FF\s])", r""),
    (r"(?<=[\u0600-\u06FF])\s+([\u064B-\u065F\u0670])", r"\1"),
    (r"خ\s*َلَ\s*ق\s*َ", r"خَلَقَ"),
    (r"ال\s*إ\s*ِ\s*نْسَا\s*ن\s*َ", r"الإِنْسَانَ"),
    (r"ال\s*إ\s*ِ\s*نْسا\s*ن\s*ُ", r"الإِنْسَانُ"),
    (r"مِ\s*ن\s*ْ", r"مِنْ"),
    (r"عَلَ\s*ق\s*ٍ", r"عَلَقٍ"),
    (r"ا\s*قْرَ\s*أْ?", r"اقْرَأْ"),
    (r"رَ\s*ب(?:[\u0651\u064F]{2}|[\u0651\u064F])?كَ", r"رَبُّكَ"),
    (r"رَ\s*ب(?:[\u0651\u0650]{2}|[\u0651\u0650])?كَ", r"رَبِّكَ"),
    (r"(?<![\u0600-\u06FF])[ْـ]\s*(?=بِاسْمِ)", r""),
    (r"ال\s*أَكْرَمُ", r"الأَكْرَمُ"),
    (r"الَّ\s*ذ\s*ِ\s*ي", r"الَّذِي"),
    (r"الَّ\s*ذ\s*ِي\s*ن\s*َ", r"الَّذِينَ"),
    (r"بِالْ\s*ق\s*َلَمِ", r"بِالْقَلَمِ"),
    (r"ي\s*َعْلَمْ", r"يَعْلَمْ"),
    (r"ي\s*َ\s*خْ\s*ش\s*َى", r"يَخْشَى"),
    (r"عِ\s*ب\s*ادِهِ", r"عِبَادِهِ"),
    (r"إ\s*ِ\s*نَّما", r"إِنَّمَا"),
    (r"يَا\s+أَ\s*يُّهَا", r"يَا أَيُّهَا"),
    (r"آمَ\s*ن\s*ُوا", r"آمَنُوا"),
    (r"ا\s*تَّ\s*ق\s*ُوا", r"اتَّقُوا"),
    (r"كُو\s*نُوا", r"كُونُوا"),
    (r"الصَّادِ\s*قِ\s*ي\s*ن\s*َ", r"الصَّادِقِينَ"),
    (r"لِ\s*ي\s*َ\s*ت\s*َ\s*ف\s*َ\s*ق\s*َّهُوا", r"لِيَتَفَقَّهُوا"),
    (r"فِ\s*ي\s+الدِّ\s*ي\s*ن\s*ِ", r"فِي الدِّينِ"),
    (r"وَلِ\s*يُ\s*ن\s*ْ\s*ذ\s*ِرُوا", r"وَلِيُنْذِرُوا"),
    (r"قَوْمَهُمْ", r"قَوْمَهُمْ"),
    (r"إ\s*ِ\s*ذ\s*َا", r"إِذَا"),
    (r"رَ\s*ج\s*َعُوا", r"رَجَعُوا"),
    (r"إ\s*ِلَ\s*يْهِمْ", r"إِلَيْهِمْ"),
    (r"ي\s*َحْ\s*ذ\s*َرُو\s*ن\s*َ?", r"يَحْذَرُونَ"),
    (r"فَلْ\s*يَ\s*ن\s*ْ\s*ظ\s*ُرِ", r"فَلْيَنْظُرِ"),
    (r"طَعامِهِ", r"طَعَامِهِ"),
    (r"يَسْ\s*ت\s*َمِعُو\s*ن\s*َ", r"يَسْتَمِعُونَ"),
    (r"الْ\s*ق\s*َوْلَ", r"الْقَوْلَ"),
    (r"فَ\s*يَ\s*تَّ\s*بِعُو\s*ن\s*َ", r"فَيَتَّبِعُونَ"),
    (r"أَحْسَ\s*نَهُ", r"أَحْسَنَهُ"),
    (r"(?<![\u0600-\u06FF])([وفلكب]?)ال(?:ك| )فايئ\b", r"\1الكفائي"),
    (r"(?<![\u0600-\u06FF])([وفلكب]?)ال(?:ع| )يي\b", r"\1العيني"),
    (r"(?<![\u0600-\u06FF])([وفلكب]?)(?:اإلس|الإس)\s+اام\b", r"\1الإسلام"),
    (r"(?<![\u0600-\u06FF])([وفلكب]?)(?:املعام|المعام)\s+اات\b", r"\1المعاملات"),
    (r"(?<![\u0600-\u06FF])([وفلكب]?)(?:االبت|الابت)\s+ااء\b", r"\1الابتلاء"),
    (r"(?<![\u0600-\u06FF])([وفلكب]?)الكر\s+مي\b", r"\1الكريم"),
    (r"(?<![\u0600-\u06FF])([وفلكب]?)خب\s+ااف\b", r"\1خلاف"),
    (r"\bف\s+اا\b", r"فلا"),
    (r"(?<![\u0600-\u06FF])([وفلكب]?)ال\s+اازِمُ?\b", r"\1اللازم"),
    (r"\bرَجُ\s+اانِ\b", r"رجلان"),
    (r"\bجَاهِ\s+ااً\b", r"جاهلاً"),
    (r"\bجَهْ\s+ااً\b", r"جهلاً"),
    (r"\bوَجِ\s+ااً\b", r"وجلاً"),
    (r"(?<![\u0600-\u06FF])([وفلكب]?)الإخ\s+ااص\b", r"\1الإخلاص"),
    (r"(?<![\u0600-\u06FF])([وفلكب]?)المكال\b", r"\1الكمال"),
    (r"\bمب(ستوى|ختلف|قدار|ا|عنى|وجب|قتضى)\b", r"بم\1"),
    (r"(?<![\u0600-\u06FF])([وفل]?)ميكن(ه?)\b", r"\1يمكن\2"),
    (r"(?<![\u0600-\u06FF])([وفل]?)ميوت\b", r"\1يموت"),
    (r"(?<![\u0600-\u06FF])([وفلبك]?)حتقيق\b", r"\1تحقيق"),
    (r"(?<![\u0600-\u06FF])([وفلبك]?)حتصيل\b", r"\1تحصيل"),
    (r"(?<![\u0600-\u06FF])([وفلبك]?)إال(?![\u0600-\u06FF])", r"\1إلا"),
    (r"(?<![\u0600-\u06FF])([وف]?)هبا(?![\u0600-\u06FF])", r"\1بها"),
    (r"(?<![\u0600-\u06FF])([وف]?)هلا(?![\u0600-\u06FF])", r"\1لها"),
    (r"(?<![\u0600-\u06FF])([وف]?)هنم(?![\u0600-\u06FF])", r"\1منهم"),
    (r"(?<![\u0600-\u06FF])([وف]?)عهنم(?![\u0600-\u06FF])", r"\1عنهم"),
    (r"(?<![\u0600-\u06FF])([وف]?)مهنا(?![\u0600-\u06FF])", r"\1منها"),
    (r"(?<![\u0600-\u06FF])([وفلبك]?)أدلهتا\b", r"\1أدلتها"),
    (r"(?<![\u0600-\u06FF])([وفلبك]?)أمهية\b", r"\1أهمية"),
    (r"(?<![\u0600-\u06FF])([وفلبك]?)صحّهتا\b", r"\1صحتها"),
    (r"(?<![\u0600-\u06FF])([وفلبك]?)الشهات\b", r"\1الشبهات"),
    (r"(?<![\u0600-\u06FF])([وفلبك]?)الإشكاالت\b", r"\1الإشكالات"),
    (r"(?<![\u0600-\u06FF])([وفلبك]?)اصطالحات\b", r"\1اصطلاحات"),
    (r"(?<![\u0600-\u06FF])([وفلبك]?)حديهثم\b", r"\1حديثهم"),
    (r"(?<![\u0600-\u06FF])([وفلبك]?)(?:الُْؤْمِنِنَ|المؤمنن)\b", r"\1المؤمنين"),
    (r"(?<![\u0600-\u06FF])([وفلبك]?)الُْسَنِْ\b", r"\1الحسن"),
    (r"(?<![\u0600-\u06FF])([وفلبك]?)عَيِِّ\b", r"\1علي"),
    (r"\bمعىً\b", r"معنىً"),
    (r"\bالقلي هلل\b", r"القلبي لله"),
    (r"\bمل\s+(يكن|يتمكّن|يدرك|يسبق|يقصد|يراع|يمكن|تكن)", r"لم \1"),
]

_compiled = [(re.compile(p), r) for p, r in RULES]


def repair(text: str) -> str:
    for pattern, replacement in _compiled:
        text = pattern.sub(replacement, text)
    return text
