"""What depends on the language and the field of the documents: patterns, word lists, weights, thresholds.

``REGULATIONS`` serves Chinese regulations. ``replace(REGULATIONS, ...)`` makes a profile for another field; patterns
are in Java's dialect, as Spark uses them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace  # noqa: F401

# Patterns, word lists and numbers that results depend on.
NUMERALS = _NUM = "一二三四五六七八九十百千万0-9"
_DOC_NO_INGEST = "财办库|财库|国办发|国发|苏财购函|苏财购|苏财规|扬财购|扬财规|扬财行|扬政务联字|扬银发|财税|财综|财金|财行|苏办发|国务院令|财政部令|公安部令|国家发展改革委令|发展改革委令"
_DOC_NO_ASKED = "财库|财办库|国办发|苏财购|扬财购|财税|财综|财金|财行"
_DOC_NO_FAST = "财库|财办库|国办发|苏财购|扬财购|财税|财综|财金|财行|国务院令|财政部令"
_DAY = r"(3[01]|[12]?\d)"
_MONTH = r"(1[0-2]|0?[1-9])"


@dataclass(frozen=True)
class Profile:
    """Fixed values of one field of documents."""

    # structure of texts
    article: str = f"第[{_NUM}]+条"
    article_any: str = f"第[{_NUM}]+[条章节款]"
    clause: str = f"第[{_NUM}]+款"
    clause_item: str = f"（[{_NUM}]+）"
    heading: str = rf"^(#{{1,6}}\s+.+|第[{_NUM}]+[章节条款].*|[0-9]+[.、].+)$"
    article_heading: str = rf"####\s*(第[{_NUM}]+条[^\n]*)"
    serial: str = r"^[（(]?[0-9一二三四五六七八九十]+[)）.、]\s*.+$"
    page_title: str = r"^第\s*[0-9一二三四五六七八九十百千万]+\s*页\s*共\s*[0-9一二三四五六七八九十百千万]+\s*页.*$"
    generic_title: str = r"^(内容|正文|附件|目录|首页|上一页|下一页|点击下载|下载)$"
    attachment_suffix: str = r"（附件:\s*[^）]+）$"
    # marked lines
    meta_keys: tuple[str, ...] = ("文档类型", "附件属性", "主文标题", "挂靠主文ID", "来源文件", "提示", "法规标题", "法规类别", "条号", "款项", "文号", "发文机关", "发布日期", "施行日期", "来源链接", "元数据", "抽取策略", "疑似扫描", "疑似乱码", "疑似摘要页", "主文判定")
    # hints
    summary_hint: str = "(发稿时间|访问量|当前位置|上一篇|下一篇|打印本页|关闭窗口)"
    summary_hint_ingest: str = "(发稿时间|访问量|当前位置|上一篇|下一篇|来源[:：]|打印本页|关闭窗口)"
    legal_cues: tuple[str, ...] = ("法", "条例", "办法", "规定", "通知", "意见")
    legal_file: str = "(办法|细则|条例|规定|通知|决定|意见|规则|指引|法|实施)"
    reference_file: str = "(封面|目录|样本|模板|清单|汇总|台账|流程|附表|格式|名录)"
    legal_attachment: str = "(办法|细则|标准|规定|条例|通知|决定|意见|合同|制度|规则|指引|规范)"
    reference_attachment: str = "(样本|模板|清单|汇总|目录|台账|流程|封面|附表|表格|格式)"
    law_title_cue: str = "(关于|办法|条例|意见|规定|通知|标准|目录)"
    # numbers of documents, dates, issuers
    doc_no: str = rf"({_DOC_NO_INGEST})\s*[〔\[（(【]?\s*(20\d{{2}})\s*[〕\]）)】]?\s*([0-9]{{1,4}})\s*号"
    doc_no_order: str = rf"({_DOC_NO_INGEST})\s*第\s*([0-9]{{1,4}})\s*号"
    doc_no_asked: str = rf"({_DOC_NO_ASKED})\s*[〔\[\(]?\s*(20\d{{2}})\s*[〕\]\)]?\s*(\d{{1,4}})\s*号"
    doc_no_fast: str = rf"({_DOC_NO_FAST})\s*[〔\[（(]?\s*(20\d{{2}})?\s*[〕\]）)]?\s*([0-9]{{1,4}})\s*号|第\s*[0-9]{{1,4}}\s*号"
    doc_no_evaluated: tuple[str, ...] = ("([\u4e00-\u9fa5]{1,8}[〔\\[]\\d{4}[〕\\]]\\d+号)", "(\\d{4}年第?\\d+号)")
    date_cn: str = rf"(20\d{{2}})\s*年\s*{_MONTH}\s*月\s*{_DAY}\s*日"
    date_iso: str = rf"(20\d{{2}})[-/.]{_MONTH}[-/.]{_DAY}"
    date_effective: str = r"(?:自|从)?\s*((?:20\d{2})\s*年\s*(?:1[0-2]|0?[1-9])\s*月\s*(?:3[01]|[12]?\d)\s*日)\s*(?:起)?(?:施行|实施|执行)"
    issuers: tuple[str, ...] = ("国务院办公厅", "国务院", "全国人大常委会", "财政部办公厅", "财政部", "江苏省财政厅", "扬州市财政局", "住房城乡建设部办公厅", "工业和信息化部办公厅", "生态环境部办公厅", "农业农村部办公厅", "国家乡村振兴局综合司", "中华全国供销合作总社办公厅", "国家发展改革委", "发展改革委", "扬州市公共资源交易中心")
    issuer_fuzzy: str = "([\\p{IsHan}]{2,24}(?:国务院办公厅|国务院|全国人大常委会|财政部办公厅|财政部|省财政厅|市财政局|财政厅|财政局|办公厅|办公室|发展改革委|工业和信息化部|住房城乡建设部|生态环境部|农业农村部|乡村振兴局|供销合作总社|公共资源交易中心))"
    regions: tuple[tuple[str, str], ...] = (("国家法规", "NATIONAL"), ("江苏省政策法规", "PROVINCIAL"), ("扬州文件制度", "MUNICIPAL"))
    categories: tuple[tuple[tuple[str, ...], str], ...] = ((("条例",), "ADMIN_REGULATION"), (("办法", "规定", "规则", "细则"), "MINISTERIAL_RULE"), (("通知", "意见", "决定", "指引"), "NORMATIVE_DOC"))
    meta_aliases: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("title", ("title", "name", "doc_title", "标题")),
        ("doc_no", ("doc_no", "docNo", "文号", "document_no")),
        ("issuer", ("issuer", "department", "发文机关", "发布机构")),
        ("publish_date", ("publish_date", "发布日期", "date", "发文日期")),
        ("effective_date", ("effective_date", "施行日期", "实施日期", "execute_date")),
        ("source_url", ("source_url", "url", "link", "来源链接")),
    )
    # words
    stopwords: tuple[str, ...] = ("什么", "哪些", "怎么", "如何", "有几种", "几种", "多少", "是否", "以及", "关于", "这个", "那个", "规定", "问题", "相关", "内容", "进行", "可以", "应当", "需要", "必须", "按照", "对于", "本级", "政策", "法规", "法律", "办法", "条例", "通知", "意见")
    question_stopwords: tuple[str, ...] = ("什么", "哪些", "怎么", "如何", "多少", "是否", "规定", "要求", "问题", "相关")
    # questions
    compare: str = "(.{2,20}?)(与|和|跟|及)(.{2,20}?)(的|之)?(适用边界|区别|差异|关系)"
    ratio_cue: str = "(20[%％]|20[汉只]|百分之二十|二十).{0,8}(价格|评审|优惠|扣除)|价格.{0,8}(扣除|减免|优惠)|评审.{0,8}优惠"
    intents: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("DEFINITION", ("什么是", "是什么", "定义", "指什么", "概念", "含义")),
        ("PROCESS", ("流程", "步骤", "怎么办", "如何办理", "怎么做")),
        ("CONDITION", ("条件", "要求", "资格", "门槛")),
        ("PENALTY", ("处罚", "责任", "罚款", "违法", "违规")),
    )
    intent_cues: tuple[tuple[str, tuple[str, ...], float], ...] = (
        ("DEFINITION", ("是指", "所称", "定义", "包括"), 0.08),
        ("PROCESS", ("程序", "步骤", "流程", "办理", "期限"), 0.07),
        ("CONDITION", ("条件", "应当", "不得", "符合", "资格"), 0.07),
        ("PENALTY", ("处罚", "罚款", "违法", "责任", "禁止"), 0.07),
    )
    broad: tuple[str, ...] = ("有哪些", "哪些", "几种", "哪几种", "多少种", "方式有哪些", "风险点", "注意事项", "核心要求", "要点", "总结", "全流程", "全面", "概述")
    fast_broad: tuple[str, ...] = ("有哪些", "要点", "清单", "总结", "流程")
    fast_compare: tuple[str, ...] = ("区别", "差异", "边界", "对比")
    fast_definition: tuple[str, ...] = ("什么是", "含义", "概念")
    method_anchor: str = "中华人民共和国政府采购法 第二十六条 采购采用以下方式 公开招标 邀请招标 竞争性谈判 单一来源采购 询价 竞争性磋商"
    ratio_words: tuple[str, ...] = ("价格减免", "价格扣除", "评审优惠", "扣除比例", "优惠比例", "百分之", "20%", "20％")
    methods: tuple[str, ...] = ("公开招标", "邀请招标", "竞争性谈判", "单一来源采购", "询价", "竞争性磋商")
    region_words: tuple[str, ...] = ("江苏", "扬州", "本市", "市本级", "省级", "地方", "苏财", "扬财", "省财政厅", "市财政局")
    local_words: tuple[str, ...] = ("provincial", "municipal", "江苏", "扬州", "本市", "市本级", "省财政厅", "市财政局")
    national_words: tuple[str, ...] = ("national", "中华人民共和国", "国务院")
    title_words: tuple[str, ...] = ("通知", "办法", "条例", "意见", "规定", "标准", "方案", "细则", "法")
    form_words: tuple[str, ...] = ("政府采购法", "条例", "办法", "规定", "通知", "意见", "令", "司法解释")
    annex_words: tuple[str, ...] = ("附件", "目录", "清单", "样表", "模板", "封面")
    # sizes
    chunk_size: int = 800
    chunk_overlap: int = 120
    max_terms: int = 72
    max_phrases: int = 24
    max_fast_terms: int = 96
    max_index_chars: int = 3200
    embedded_chars: int = 1800
    fast_embedded_chars: int = 1400
    snippet_chars: int = 760
    answer_chars: int = 12000
    top_k: int = 24
    fast_recall: int = 50
    fast_rerank: int = 8


REGULATIONS = Profile()
