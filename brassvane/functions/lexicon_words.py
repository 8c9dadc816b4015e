"""The sentiment lexicon's words and weights, modifiers and sentence patterns."""

POSITIVE = {
    "涨停": 2.5, "大涨": 2.0, "暴涨": 2.5, "领涨": 1.5, "走强": 1.0, "强势": 1.0, "新高": 1.5, "反包": 1.0, "反弹": 0.8, "拉升": 1.2,
    "上涨": 1.2, "收涨": 1.0, "高开": 0.8, "利好": 2.0, "超预期": 2.0, "好于预期": 2.0, "扭亏": 2.0, "预增": 2.5, "预盈": 2.0, "盈利": 1.5,
    "增长": 0.8, "提升": 0.8, "增持": 1.5, "回购": 1.5, "中标": 2.0, "签订": 1.2, "订单": 1.0, "合同": 1.0, "获批": 1.5, "批准": 1.0,
    "分红": 1.0, "派息": 1.0, "战略合作": 1.2, "上调": 1.2, "加码": 0.8, "定增": 0.3, "净流入": 1.5, "抢筹": 1.5, "加仓": 1.0, "买入": 0.8,
    "增持计划": 1.8, "满产": 1.0, "供不应求": 1.5, "涨价": 0.8, "提价": 0.8, "突破": 1.0, "拓展": 0.5, "创新高": 1.8, "历史新高": 2.0,
    "摘帽": 2.0, "摘星": 1.5, "脱帽": 1.5, "定点协议": 1.5, "项目定点": 1.5, "量价齐升": 1.5, "景气": 0.8, "复牌": 0.5, "派发": 1.0, "分红派现": 1.2,
    "注册批复": 1.5, "审核通过": 1.5, "获受理": 1.0, "上市申请": 1.0, "注册证书": 1.5, "获同意": 1.0, "拟收购": 1.0, "收购": 0.8, "参设": 1.0,
    "增资": 0.8, "参股": 0.8, "对外投资": 0.8, "入主": 1.0, "核心供应商": 1.0, "批量生产": 1.0, "批产": 1.0, "下单": 0.8, "补库存": 0.8,
    "配套": 0.8, "扩大": 0.8, "自主研发": 0.8, "发明专利": 1.0, "提速": 0.8,
}
NEGATIVE = {
    "跌停": 2.5, "大跌": 2.0, "暴跌": 2.5, "领跌": 1.5, "走弱": 1.0, "新低": 1.5, "跳水": 1.5, "闪崩": 2.5, "腰斩": 2.0, "下挫": 1.0,
    "下跌": 1.2, "收跌": 1.0, "低开": 0.8, "利空": 2.0, "低于预期": 2.0, "不及预期": 2.0, "预亏": 2.5, "亏损": 1.8, "下滑": 1.0, "下降": 0.8,
    "减少": 0.6, "下调": 1.2, "减持": 1.8, "清仓式减持": 2.5, "质押": 0.8, "违规": 2.0, "处罚": 2.0, "罚款": 1.5, "立案": 2.5, "警示": 1.5,
    "退市": 2.5, "退市风险": 2.5, "违约": 2.0, "诉讼": 1.2, "仲裁": 1.0, "商誉减值": 2.0, "减值": 1.5, "停牌": 0.8, "破发": 1.5, "破产": 2.5,
    "重整": 1.0, "被查": 2.0, "问询": 1.2, "净流出": 1.5, "出逃": 1.5, "抛售": 1.5, "减仓": 1.0, "卖出": 0.8, "减持计划": 2.0, "死叉": 1.2,
    "撤离": 1.5, "重挫": 2.0, "萎缩": 1.2, "连亏": 2.0, "失血": 1.2, "辞职": 1.0, "泥潭": 1.2, "停产": 2.0, "超标": 1.5, "债务": 0.5,
}
DEGREES = {"大幅": 1.5, "显著": 1.3, "明显": 1.2, "略微": 0.6, "小幅": 0.7, "罕见": 1.3, "创纪录": 1.5, "翻倍": 1.5, "倍增": 1.4}
NEGATIONS = ["未", "不", "没有", "难以", "暂未", "并未", "无法", "不再"]
CANCELS = ["撤销", "取消", "解除", "豁免"]
DEGREE_WINDOW, NEGATION_WINDOW, CANCEL_WINDOW, FLIP = 3, 4, 12, -0.9
TITLE_WEIGHT, THRESHOLD, CONFIDENCE_NORM = 2.0, 1.0, 3.0
PATTERNS = [
    (r"同比\s*(?:大幅\s*)?(增长|增加|上升|提高|提升)", "pat_yoy_up", 1.5),
    (r"同比\s*(?:大幅\s*)?(下降|下滑|减少|降低|下跌)", "pat_yoy_down", -1.5),
    (r"环比\s*(增长|增加|上升)", "pat_qoq_up", 1.2),
    (r"环比\s*(下降|下滑|减少)", "pat_qoq_down", -1.2),
    (r"净利润\s*预(?:增|盈)", "pat_np_forecast_up", 2.0),
    (r"净利润\s*预(?:亏|减|降)", "pat_np_forecast_down", -2.0),
    (r"(?:业绩|净利)[^。]{0,10}(?:翻倍|倍增|创历史)", "pat_record_up", 1.5),
    (r"主力[^。]{0,8}净流入", "pat_main_inflow", 1.2),
    (r"主力[^。]{0,8}净流出", "pat_main_outflow", -1.2),
    (r"撤销(?:其他)?风险警示", "pat_delist_warning_removed", 2.5),
    (r"(?:撤销|取消)\s*退市风险警示", "pat_delist_removed", 3.0),
    (r"10\s*派\s*[\d.]+\s*元", "pat_dividend", 1.5),
    (r"同比增(?![长加])", "pat_yoy_up_bare", 1.2),
    (r"融资余额[^。]{0,6}增加", "pat_margin_up", 1.2),
    (r"增收不增利", "pat_rev_not_profit", -1.5),
    (r"净利润[^。]{0,6}减亏", "pat_np_loss_narrow", -1.5),
    (r"跌幅[^。]{0,6}偏离", "pat_deviation_down", -1.2),
]
