"""Controlled vocabularies, aliases and defaults of the label dimensions."""

# Labels of each dimension in code order.
LABELS = {
    "D1": ["八主神", "帝君", "星君", "神将", "真君仙人", "玉女侍从", "三官地府", "先导护卫", "云气装饰", "背景留白"],
    "D2": ["十二旒冕", "九旒八旒冕", "通天冠", "进贤冠", "凤冠", "道冠", "花冠", "小冠", "远游冠", "金冠", "簪头", "皮弁", "披发", "幞头扎抹额", "风帽", "双鬟髻", "无", "N/A"],
    "D3": ["笏板", "塵拂", "宝剑", "经卷如意", "旗帜", "乐器", "托盘供品", "兵器", "印诀法器", "天文器具", "宫扇", "龙杖", "空手", "N/A"],
    "D4": ["完好", "轻微损伤", "中度损伤", "严重损伤", "古代补绘"],
    "D5": ["前景", "中景", "背景", "云气区"],
    "P1": ["起甲", "龟裂", "脱落", "褪色", "变色", "完好"],
    "P2": ["空鼓", "酥碱", "裂隙", "粉化", "完好"],
    "P3": ["裂隙", "渗水", "变形", "完好"],
    "P4": ["烟熏", "霉斑", "积尘", "涂写", "无"],
}
# Dimensions whose labels may be given as numbers, and the first number.
CODES = {"D1": 1, "D4": 0, "D5": 1}
# What raters write instead of a label.
ALIASES = {
    "D1": {
        "主神帝君": "八主神", "主神": "八主神", "天尊": "八主神", "天王神将": "神将", "仙官真人": "真君仙人", "侍从仙女": "玉女侍从", "供养人像": "先导护卫",
        "云气祥瑞": "云气装饰", "云气": "云气装饰", "纹饰图案": "云气装饰", "建筑宫殿": "背景留白", "法器器物": "背景留白", "留白": "背景留白", "background": "背景留白", "blank": "背景留白",
        "玉女": "玉女侍从", "力士": "神将", "天丁": "先导护卫", "真人": "真君仙人", "仙官": "真君仙人", "龙虎": "先导护卫",
    },
    "D2": {
        "十二旒": "十二旒冕", "12旒冕": "十二旒冕", "九旒冕": "九旒八旒冕", "八旒冕": "九旒八旒冕", "莲花冠": "花冠", "芙蓉冠": "花冠", "束发金冠": "金冠", "束发冠": "金冠",
        "无冠": "无", "无冠饰": "无", "none": "无", "n/a": "N/A", "na": "N/A", "五岳冠": "道冠", "星冠": "道冠", "宝髻": "双鬟髻", "扎巾帻": "幞头扎抹额",
        "兜鍪": "皮弁", "卷云发": "披发", "抹额": "幞头扎抹额", "其他冠饰": "无",
    },
    "D3": {
        "圭板": "笏板", "拂尘": "塵拂", "如意": "经卷如意", "兵刃": "兵器", "龙旗": "旗帜", "长幡": "旗帜", "障扇": "宫扇", "团扇": "宫扇", "三天火印": "印诀法器", "火印": "印诀法器", "法铃": "印诀法器",
        "帝钟": "天文器具", "香炉": "托盘供品", "宝瓶": "托盘供品", "供品": "托盘供品", "玉杯": "托盘供品", "花枝": "托盘供品", "经卷": "经卷如意", "无持物": "空手", "无": "空手", "none": "空手",
        "n/a": "N/A", "na": "N/A", "其他法器": "印诀法器",
    },
    "D4": {
        "轻度损伤": "轻微损伤", "中度": "中度损伤", "重度损伤": "严重损伤", "严重": "严重损伤", "极重": "严重损伤", "none": "完好",
        "轻微破损": "轻微损伤", "中度破损": "中度损伤", "严重破损": "严重损伤", "颜料脱落": "严重损伤",
    },
    "D5": {
        "前景主体": "前景", "中景过渡": "中景", "背景装饰": "背景", "边缘过渡": "背景", "云气带": "云气区", "云气": "云气区", "上层": "前景", "中层": "中景", "下层": "背景", "跨层": "前景",
    },
}
# The label of a blank or unknown answer.
DEFAULTS = {"D1": "背景留白", "D2": "N/A", "D3": "N/A", "D4": "严重损伤", "D5": "中景", "P1": "完好", "P2": "完好", "P3": "完好", "P4": "无"}
# Severities, their weights, and labels that rule sets name.
SEVERITY = {"intact": "完好", "mild": "轻微", "moderate": "中度", "severe": "严重", "critical": "濒危"}
SEVERITY_WEIGHT = {"intact": 0.0, "mild": 0.2, "moderate": 0.5, "severe": 0.8, "critical": 1.0}
PSEUDO = ["none", "null", "", "unknown", "other", "normal"]
NO_FIGURE = ["云气装饰", "背景留白"]
LEADING = ["八主神", "帝君"]
MILITARY = ["神将", "先导护卫"]
IMPERIAL_CROWNS = ["十二旒冕", "通天冠"]
