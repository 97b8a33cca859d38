"""Chinese terms of science and their English ones, and the long forms of common acronyms."""

TOPICS = (
    ("表面磁化", "surface magnetization"), ("表面磁矩", "surface magnetic moment"), ("反铁磁", "antiferromagnetic"), ("铁磁", "ferromagnetic"), ("磁电", "magnetoelectric"), ("自旋电子", "spintronics"),
    ("自旋", "spin"), ("磁化", "magnetization"), ("磁矩", "magnetic moment"), ("表面", "surface"), ("界面", "interface"), ("薄膜", "thin film"), ("材料", "materials"), ("二维", "two-dimensional"),
    ("第一性原理", "first-principles"), ("密度泛函", "density functional theory"), ("计算", "computational"), ("实验", "experimental"), ("理论", "theoretical"), ("机制", "mechanism"), ("意义", "significance"),
    ("重要性", "importance"), ("影响", "effect"), ("应用", "applications"), ("性质", "properties"), ("调控", "control"), ("检测", "detection"), ("综述", "review"), ("文献", "literature"), ("筛选", "screening"),
    ("证据", "evidence"), ("验证", "verification"), ("人工反馈", "human feedback"), ("大语言模型", "large language model"), ("语言模型", "language model"), ("大模型", "large language model"), ("多智能体", "multi-agent"),
)

TRANSLATIONS = {
    "锂离子电池": "lithium-ion battery", "电池": "battery", "界面": "interface", "负极": "anode", "电解液": "electrolyte", "组成": "composition", "结构": "structure", "演化": "evolution", "表征": "characterization",
    "实验表征": "experimental characterization", "理论背景": "theoretical background", "理论机制": "theoretical mechanism", "原位": "in situ", "非原位": "ex situ", "失效机制": "failure mechanism", "失效": "failure",
    "过渡金属氧化物": "transition metal oxide", "氧化物": "oxide", "催化剂": "catalyst", "表面自旋态": "surface spin state", "自旋态": "spin state", "电子结构": "electronic structure",
    "析氧反应": "oxygen evolution reaction", "电催化剂": "electrocatalyst", "活性": "activity", "争议点": "controversy", "争议": "controversy", "系统综述": "systematic review", "文献筛选": "literature screening",
    "人机协作": "human-in-the-loop", "人工反馈": "human feedback", "证据验证": "evidence validation; evidence verification", "召回率": "recall", "筛选准确率": "screening accuracy", "准确率": "accuracy",
    "薄膜沉积": "thin film deposition", "沉积方法": "deposition methods", "薄膜": "thin film", "优缺点": "advantages disadvantages", "比较": "comparison", "综述": "review", "捕集": "capture", "孔径": "pore size",
    "官能团": "functional groups", "水稳定性": "water stability", "吸附性能": "adsorption performance", "典型材料": "representative materials", "典型材料体系": "representative material systems",
    "应用限制": "application limitations", "钙钛矿太阳能电池": "perovskite solar cell", "缺陷钝化": "defect passivation", "缺陷态": "defect states", "载流子复合": "carrier recombination",
}

EXPANSIONS = {
    "SEI": "SEI; solid electrolyte interphase", "OER": "OER; oxygen evolution reaction", "CO2": "CO2; carbon dioxide", "LLM": "LLM; large language model", "ALD": "ALD; atomic layer deposition",
    "PLD": "PLD; pulsed laser deposition", "CVD": "CVD; chemical vapor deposition",
}
