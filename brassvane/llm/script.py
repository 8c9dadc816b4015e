"""Folding of text as people vary it: width, case, look-alikes, separators and common traditional characters."""

from __future__ import annotations

import re
import unicodedata

# Common traditional characters, each followed by its simplified form.
TRADITIONAL = (
    "萬万 億亿 與与 專专 業业 東东 個个 豐丰 臨临 為为 麗丽 舉举 義义 烏乌 樂乐 習习 鄉乡 書书 買买 亂乱 爭争 亞亚 產产 親亲 僅仅 從从 倉仓 們们 價价 眾众 優优 會会 傳传 傷伤 倫伦 "
    "體体 餘余 傭佣 俠侠 僑侨 債债 傾倾 償偿 兒儿 黨党 蘭兰 關关 興兴 養养 獸兽 內内 冊册 寫写 軍军 農农 馮冯 沖冲 決决 況况 凍冻 淨净 準准 涼凉 減减 湊凑 鳳凤 憑凭 凱凯 擊击 劃划 劉刘 "
    "則则 剛刚 創创 刪删 別别 劑剂 勸劝 辦办 務务 動动 勵励 勁劲 勞劳 勢势 區区 醫医 華华 協协 單单 賣卖 盧卢 衛卫 卻却 廠厂 廳厅 歷历 壓压 厭厌 縣县 參参 雙双 發发 變变 葉叶 號号 嘆叹 後后 "
    "嚇吓 嗎吗 啟启 吳吴 員员 聽听 響响 團团 園园 圍围 國国 圖图 圓圆 聖圣 場场 壞坏 塊块 堅坚 壇坛 墳坟 墊垫 塵尘 聲声 殼壳 處处 備备 複复 夠够 頭头 夾夹 奪夺 奮奋 獎奖 婦妇 媽妈 孫孙 學学 "
    "寧宁 寶宝 實实 審审 憲宪 宮宫 寬宽 賓宾 對对 尋寻 導导 壽寿 將将 爾尔 塵尘 嘗尝 層层 屬属 歲岁 島岛 幣币 帥帅 師师 帳帐 帶带 幫帮 廣广 莊庄 慶庆 庫库 應应 廟庙 廢废 開开 異异 棄弃 張张 彈弹 強强 歸归 當当 錄录 徹彻 "
    "徑径 憂忧 懷怀 態态 憐怜 總总 戀恋 惡恶 懸悬 驚惊 懲惩 慘惨 慣惯 憤愤 願愿 戲戏 戰战 戶户 撲扑 執执 擴扩 掃扫 揚扬 擾扰 撫抚 拋抛 搶抢 護护 報报 擔担 擬拟 擁拥 擇择 掛挂 揮挥 換换 據据 擠挤 損损 敵敌 數数 斷断 無无 "
    "舊旧 時时 曠旷 曉晓 術术 機机 殺杀 雜杂 權权 條条 來来 極极 構构 標标 樹树 樣样 橋桥 檢检 歐欧 殘残 氣气 漢汉 湯汤 溝沟 沒没 滬沪 淚泪 濟济 測测 濁浊 潔洁 灑洒 漲涨 淵渊 漁渔 滲渗 滿满 濫滥 災灾 爐炉 點点 煉炼 燒烧 熱热 "
    "愛爱 爺爷 牽牵 犧牺 狀状 獨独 獄狱 猶犹 獲获 環环 現现 電电 畫画 暢畅 療疗 瘋疯 盤盘 監监 盜盗 礦矿 碼码 磚砖 確确 禮礼 禍祸 離离 種种 積积 稱称 穩稳 窮穷 競竞 筆笔 築筑 籤签 簽签 簡简 類类 糧粮 緊紧 糾纠 紅红 約约 級级 純纯 "
    "紙纸 線线 練练 組组 細细 織织 終终 紹绍 經经 結结 給给 絕绝 統统 繼继 績绩 續续 維维 綜综 綠绿 網网 羅罗 罰罚 聯联 職职 聰聪 腦脑 臟脏 臉脸 膽胆 勝胜 脫脱 艱艰 藝艺 節节 蘇苏 蟲虫 蠻蛮 補补 裝装 見见 規规 視视 覺觉 觀观 訂订 認认 討讨 讓让 訓训 議议 記记 "
    "講讲 許许 論论 設设 訪访 證证 評评 識识 詐诈 訴诉 診诊 詞词 試试 話话 該该 詳详 語语 誤误 說说 請请 諸诸 讀读 課课 誰谁 調调 談谈 謀谋 謝谢 謠谣 貝贝 負负 財财 責责 賢贤 敗败 貨货 質质 販贩 貪贪 貧贫 購购 貫贯 賤贱 貼贴 貴贵 貸贷 貿贸 費费 賀贺 賊贼 資资 賦赋 "
    "賭赌 賞赏 賠赔 賺赚 賽赛 趙赵 趕赶 趨趋 躍跃 踐践 車车 軌轨 轉转 輪轮 軟软 輕轻 載载 較较 輔辅 輛辆 輩辈 輸输 轄辖 邊边 達达 遷迁 過过 運运 還还 這这 進进 遠远 違违 連连 遲迟 適适 選选 遺遗 郵邮 鄰邻 釀酿 釋释 裡里 鑒鉴 針针 釘钉 鈔钞 鋼钢 錢钱 鑽钻 鐵铁 銷销 鎖锁 鋒锋 錯错 鍋锅 長长 門门 閉闭 "
    "問问 間间 閱阅 闆板 隊队 陽阳 陰阴 陣阵 階阶 際际 陸陆 陳陈 險险 隨随 隱隐 難难 霧雾 靜静 頂顶 項项 順顺 須须 顧顾 頓顿 預预 領领 頻频 題题 額额 顏颜 顯显 風风 飛飞 飯饭 飲饮 飼饲 飾饰 館馆 馬马 駐驻 駕驾 罵骂 驗验 騙骗 驟骤 魚鱼 鮮鲜 鳥鸟 雞鸡 鳴鸣 鹽盐 麥麦 黃黄 齊齐 齒齿 龍龙 龜龟 龐庞 佔占 佈布 髒脏 婊婊 補补 計计 劣劣 機机 獲获 遭遭 貶贬 漸渐 續续 銀银 衝冲 濟济 週周 採采 滾滚 醜丑 幹干"
)


def _fold_table() -> dict[int, str]:
    return {ord(p[0]): p[1] for p in TRADITIONAL.split() if len(p) == 2 and p[0] != p[1]}


FOLD = _fold_table()
# Look-alike digits and signs inside Latin words.
LOOKALIKE = str.maketrans("4301@$5!", "aeoiassi")
_DIGIT_IN_WORD = re.compile(r"(?<=[a-z])[4301@$5!](?=[a-z])")
_INVISIBLE = re.compile(r"[­​-‏‪-‮⁠-⁤﻿\x00-\x08\x0b-\x1f\x7f]")


def fold(text: str) -> str:
    """Full-width to half-width, lower case, no invisible characters, traditional to simplified."""
    return _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower().translate(FOLD)


def unmask(text: str) -> str:
    """fold(), with look-alikes inside Latin words undone."""
    return _DIGIT_IN_WORD.sub(lambda m: m[0].translate(LOOKALIKE), fold(text))
