"""The whole table of kanji variants: representative -> its variants."""

# Fixed values, one line each.
VARIANTS = {
    "が": "ケヶガ",
    "っ": "ツッ",
    "の": "ノ乃之",
    "エ": "ヱェ",
    "亜": "亞",
    "秋": "穐龝",
    "悪": "惡",
    "芦": "蘆",
    "鯵": "鰺",
    "圧": "壓",
    "庵": "菴",
    "囲": "圍",
    "為": "爲",
    "医": "醫",
    "飯": "飯",
    "育": "毓",
    "一": "弌",
    "壱": "壹",
    "稲": "稻",
    "飲": "飮",
    "淫": "婬",
    "隠": "隱",
    "韻": "韵",
    "卯": "夘",
    "羽": "羽",
    "欝": "鬱",
    "厩": "廐廏",
    "叡": "睿",
    "営": "營",
    "映": "暎",
    "曳": "曵",
    "栄": "榮",
    "穎": "頴",
    "衛": "衞",
    "詠": "咏",
    "駅": "驛",
    "円": "圓",
    "煙": "烟",
    "艶": "艷",
    "塩": "鹽",
    "園": "薗",
    "奥": "奧",
    "往": "徃",
    "応": "應",
    "欧": "歐",
    "殴": "毆",
    "鶯": "鴬",
    "岡": "堽崗",
    "沖": "冲",
    "穏": "穩",
    "仮": "假",
    "価": "價",
    "嘩": "譁",
    "峨": "峩",
    "画": "畫",
    "会": "會",
    "解": "觧",
    "回": "囘",
    "壊": "壞",
    "怪": "恠",
    "懐": "懷",
    "界": "畍堺",
    "絵": "繪",
    "核": "㧡",
    "蟹": "蠏",
    "崖": "崕",
    "碍": "礙",
    "蓋": "盖葢",
    "蛎": "蠣",
    "鈎": "鉤",
    "拡": "擴",
    "撹": "攪",
    "殻": "殼",
    "覚": "覺",
    "学": "學斈",
    "岳": "嶽",
    "楽": "樂",
    "竃": "竈",
    "釜": "釡",
    "柏": "栢",
    "粥": "鬻",
    "刈": "苅",
    "刊": "刋",
    "勧": "勸",
    "巻": "卷",
    "歓": "歡",
    "潅": "灌",
    "缶": "罐",
    "観": "觀",
    "諌": "諫",
    "鑑": "鑒",
    "関": "關",
    "陥": "陷",
    "館": "舘",
    "鉋": "銫",
    "巌": "巖",
    "岩": "嵒",
    "雁": "鴈鳫",
    "顔": "顏",
    "喜": "憙",
    "器": "噐",
    "奇": "竒",
    "期": "朞",
    "棋": "棊",
    "棄": "弃",
    "帰": "歸皈",
    "気": "氣气",
    "亀": "龜",
    "詰": "誥",
    "磯": "礒",
    "偽": "僞",
    "戯": "戲",
    "犠": "犧",
    "宜": "冝",
    "砧": "碪",
    "却": "卻",
    "糾": "糺",
    "旧": "舊",
    "拠": "據",
    "挙": "擧舉",
    "京": "亰",
    "協": "恊",
    "峡": "峽",
    "挟": "挾",
    "況": "况",
    "狭": "狹",
    "尭": "堯",
    "暁": "曉",
    "区": "區",
    "駆": "驅駈",
    "榑": "槫",
    "勲": "勳",
    "群": "羣",
    "圭": "珪",
    "径": "徑逕",
    "恵": "惠",
    "憩": "憇",
    "携": "攜",
    "渓": "溪谿",
    "経": "經",
    "継": "繼",
    "茎": "莖",
    "蛍": "螢",
    "軽": "輕",
    "頚": "頸",
    "鶏": "鷄",
    "荊": "荆",
    "芸": "藝",
    "欠": "缺",
    "決": "决",
    "倹": "儉",
    "券": "劵",
    "剣": "劍劔劒剱釼",
    "圏": "圈",
    "検": "檢",
    "権": "權",
    "献": "獻",
    "県": "縣",
    "険": "險",
    "顕": "顯",
    "験": "驗",
    "厳": "嚴",
    "虎": "乕",
    "鼓": "皷",
    "菰": "薦",
    "高": "髙",
    "効": "效",
    "広": "廣",
    "恒": "恆",
    "晃": "晄",
    "稿": "稾藁",
    "耕": "畊",
    "鉱": "砿礦鑛",
    "劫": "刧",
    "号": "號",
    "郷": "鄕",
    "轟": "軣",
    "国": "國圀",
    "嵯": "嵳",
    "左": "佐",
    "砕": "碎",
    "斉": "齋斎齊済薺斉齎齏霽濟",
    "剤": "劑",
    "坂": "阪",
    "崎": "嵜埼碕﨑",
    "作": "做",
    "桜": "櫻",
    "冊": "册",
    "雑": "雜襍",
    "皐": "皋",
    "参": "參",
    "惨": "慘",
    "桟": "棧",
    "蚕": "蠶",
    "讃": "讚",
    "賛": "贊",
    "残": "殘",
    "糸": "絲",
    "紙": "帋",
    "歯": "齒",
    "事": "亊",
    "児": "兒",
    "爾": "尓",
    "辞": "辭",
    "宍": "肉",
    "湿": "濕",
    "質": "貭",
    "実": "實",
    "篠": "筱",
    "蕊": "蘂蕋",
    "舎": "舍",
    "写": "冩寫",
    "釈": "釋",
    "呪": "咒",
    "寿": "壽",
    "州": "洲",
    "収": "收",
    "讐": "讎",
    "従": "從从",
    "渋": "澁澀",
    "獣": "獸",
    "縦": "縱",
    "粛": "肅",
    "準": "凖",
    "潤": "閏",
    "処": "處",
    "薯": "藷",
    "叙": "敍敘",
    "嘗": "甞",
    "奨": "奬獎",
    "将": "將",
    "廠": "厰",
    "松": "枩",
    "焼": "燒",
    "称": "稱",
    "証": "證",
    "乗": "乘",
    "剰": "剩",
    "場": "塲",
    "壌": "壤",
    "嬢": "孃",
    "条": "條",
    "浄": "淨",
    "畳": "疊疉疂",
    "穣": "穰",
    "譲": "讓",
    "醸": "釀",
    "嘱": "囑",
    "飾": "餝",
    "触": "觸",
    "神": "神",
    "唇": "脣",
    "寝": "寢",
    "慎": "愼",
    "晋": "晉",
    "真": "眞",
    "刃": "刄",
    "尽": "盡",
    "靭": "靫靱",
    "酢": "醋",
    "図": "圖",
    "厨": "廚",
    "垂": "埀",
    "粋": "粹",
    "翠": "翆",
    "酔": "醉",
    "随": "隨",
    "髄": "膸髓",
    "数": "數",
    "枢": "樞",
    "杉": "椙",
    "澄": "澂",
    "世": "丗",
    "畝": "畆",
    "青": "靑",
    "背": "脊",
    "凄": "淒",
    "棲": "栖",
    "声": "聲",
    "清": "淸",
    "静": "靜",
    "跡": "迹蹟",
    "摂": "攝",
    "窃": "竊",
    "接": "椄",
    "専": "專",
    "戦": "戰",
    "浅": "淺",
    "潜": "潛濳",
    "線": "綫",
    "繊": "纖纎",
    "船": "舩舟",
    "賎": "賤",
    "践": "踐",
    "銭": "錢",
    "善": "譱",
    "禅": "禪",
    "曾": "曽",
    "疎": "踈",
    "蘇": "蘓",
    "遡": "溯泝",
    "鼠": "鼡",
    "粕": "糟",
    "双": "雙",
    "壮": "壯",
    "捜": "搜",
    "挿": "插",
    "争": "爭",
    "窓": "窗",
    "総": "總",
    "聡": "聰",
    "荘": "莊",
    "装": "裝",
    "走": "赱",
    "騒": "騷",
    "桑": "桒",
    "槍": "鑓鎗",
    "臓": "臟",
    "蔵": "藏",
    "属": "屬",
    "賊": "戝",
    "続": "續",
    "卒": "卆",
    "村": "邨",
    "多": "夛",
    "堕": "墮",
    "柁": "舵",
    "楕": "橢",
    "体": "躰體軆",
    "対": "對",
    "帯": "帶",
    "滞": "滯",
    "台": "臺",
    "滝": "瀧",
    "択": "擇",
    "沢": "澤",
    "鐸": "鈬",
    "達": "逹",
    "竪": "豎",
    "狸": "貍",
    "単": "單",
    "担": "擔",
    "胆": "膽",
    "団": "團",
    "弾": "彈",
    "断": "斷",
    "恥": "耻",
    "痴": "癡",
    "稚": "穉",
    "遅": "遲",
    "昼": "晝",
    "虫": "蟲",
    "鋳": "鑄",
    "瀦": "潴",
    "猪": "豬",
    "庁": "廳廰",
    "町": "甼",
    "聴": "聽",
    "腸": "膓",
    "勅": "敕",
    "珍": "珎",
    "鎮": "鎭",
    "壷": "壺",
    "逓": "遞",
    "鉄": "銕鐵鐡",
    "纏": "纒",
    "転": "轉",
    "点": "點",
    "伝": "傳",
    "兎": "菟兔莵",
    "砺": "礪",
    "党": "黨",
    "島": "嶋嶌",
    "梼": "檮",
    "盗": "盜",
    "涛": "濤",
    "灯": "燈",
    "当": "當",
    "豆": "荳",
    "逃": "迯",
    "闘": "鬪",
    "祷": "禱",
    "働": "仂",
    "徳": "悳德",
    "独": "獨",
    "読": "讀",
    "栃": "杤",
    "届": "屆",
    "縄": "繩",
    "二": "弍弐貳貮",
    "迩": "邇",
    "韮": "韭",
    "妊": "姙",
    "禰": "祢",
    "粘": "黏",
    "廼": "迺",
    "悩": "惱",
    "脳": "腦",
    "覇": "霸",
    "波": "浪",
    "廃": "廢",
    "拝": "拜",
    "杯": "盃",
    "稗": "薭",
    "梅": "楳",
    "売": "賣",
    "蝿": "蠅",
    "麦": "麥",
    "函": "凾",
    "発": "發",
    "髪": "髮",
    "罰": "罸",
    "抜": "拔",
    "範": "笵",
    "蛮": "蠻",
    "秘": "祕",
    "桧": "檜",
    "氷": "冰",
    "浜": "濱濵",
    "富": "冨",
    "福": "福",
    "淵": "渕渊",
    "払": "拂",
    "仏": "佛",
    "幣": "幤",
    "並": "竝",
    "閉": "閇",
    "箆": "篦",
    "変": "變",
    "辺": "邊邉",
    "弁": "辨辧瓣辯",
    "舗": "舖鋪",
    "穂": "穗",
    "宝": "寶寳",
    "峰": "峯",
    "萌": "萠",
    "褒": "襃",
    "豊": "豐",
    "砲": "炮",
    "冒": "冐",
    "貌": "皃",
    "茅": "萱",
    "没": "沒",
    "本": "夲",
    "翻": "飜",
    "槙": "槇",
    "桝": "枡",
    "侭": "儘",
    "万": "萬",
    "満": "滿",
    "蓑": "簑簔",
    "脈": "脉",
    "夢": "梦",
    "無": "无",
    "婿": "壻聟",
    "綿": "緜",
    "麺": "麪",
    "黙": "默",
    "餅": "餠",
    "埜": "野",
    "弥": "彌",
    "薬": "藥",
    "訳": "譯",
    "薮": "籔藪",
    "癒": "瘉",
    "湧": "涌",
    "予": "豫",
    "余": "餘",
    "与": "與",
    "誉": "譽",
    "揺": "搖",
    "様": "樣",
    "熔": "鎔",
    "窯": "窰",
    "耀": "燿",
    "謡": "謠",
    "踊": "踴",
    "遥": "遙",
    "来": "來徠",
    "乱": "亂",
    "覧": "覽",
    "裏": "裡",
    "略": "畧",
    "溜": "澑",
    "留": "畄",
    "竜": "龍",
    "柳": "栁",
    "両": "兩",
    "涼": "凉",
    "猟": "獵",
    "瞭": "暸",
    "糧": "粮",
    "梁": "簗",
    "隣": "鄰",
    "瑠": "璢",
    "塁": "壘",
    "涙": "泪",
    "累": "縲",
    "励": "勵",
    "礼": "禮",
    "隷": "隸",
    "霊": "靈㚑",
    "齢": "齡",
    "恋": "戀",
    "聯": "聨",
    "炉": "爐",
    "労": "勞",
    "朗": "朖",
    "楼": "樓",
    "篭": "籠",
    "禄": "祿",
    "亙": "亘",
    "湾": "灣",
    "仞": "仭",
    "佇": "竚",
    "俎": "爼",
    "倅": "伜",
    "僭": "僣",
    "冤": "寃",
    "冦": "寇",
    "冪": "羃",
    "冱": "沍",
    "冽": "洌",
    "剋": "尅",
    "剳": "箚",
    "匳": "奩",
    "卮": "巵",
    "厠": "廁",
    "厦": "廈",
    "厮": "廝",
    "啖": "啗",
    "喀": "咯",
    "噪": "譟",
    "嚔": "嚏",
    "囓": "齧",
    "址": "阯",
    "坡": "陂",
    "埒": "埓",
    "墻": "牆",
    "壜": "罎",
    "奘": "弉",
    "佞": "侫",
    "嫺": "嫻",
    "嬲": "嫐",
    "崙": "崘",
    "嵌": "篏",
    "廸": "迪",
    "彝": "彜",
    "彎": "弯",
    "彿": "髴",
    "惧": "懼",
    "悴": "忰",
    "慙": "慚",
    "懺": "懴",
    "戛": "戞",
    "扞": "捍",
    "扠": "扨",
    "拏": "拿",
    "揀": "柬",
    "擡": "抬",
    "旛": "旙",
    "昜": "暘",
    "曖": "瞹",
    "曠": "昿",
    "杠": "槓",
    "梹": "檳",
    "椁": "槨",
    "棕": "椶",
    "樒": "櫁",
    "檐": "簷",
    "檗": "蘗",
    "櫑": "罍",
    "櫟": "檪",
    "殲": "殱",
    "浣": "澣",
    "凅": "涸",
    "炯": "烱",
    "煕": "熈",
    "熏": "燻",
    "爍": "鑠",
    "牋": "箋",
    "犂": "犁",
    "犲": "豺",
    "狢": "貉",
    "猊": "貎",
    "獏": "貘",
    "琅": "瑯",
    "瑙": "碯",
    "瑶": "瑤",
    "瓔": "珱",
    "甎": "磚",
    "疇": "畴",
    "疣": "肬",
    "痲": "痳",
    "皰": "靤",
    "皸": "皹",
    "盪": "蘯",
    "眥": "眦",
    "睹": "覩",
    "稟": "禀",
    "筐": "筺",
    "筍": "笋",
    "箘": "箟",
    "箏": "筝",
    "籐": "籘",
    "籤": "籖",
    "籥": "龠",
    "纃": "緕",
    "羈": "覊羇",
    "羹": "羮",
    "腮": "顋",
    "膣": "腟",
    "膾": "鱠",
    "臘": "臈",
    "艫": "舮",
    "芻": "蒭",
    "苺": "莓",
    "萼": "蕚",
    "蒂": "蔕",
    "薀": "蘊",
    "虱": "蝨",
    "螳": "蟷",
    "蟇": "蟆",
    "蠎": "蟒",
    "蠹": "蠧",
    "衄": "衂",
    "衽": "袵",
    "襌": "褝",
    "訛": "譌",
    "謚": "諡",
    "譖": "譛",
    "貔": "豼",
    "贓": "賍",
    "跖": "蹠",
    "蹤": "踪",
    "躙": "躪",
    "輒": "輙",
    "輛": "輌",
    "轢": "轣",
    "逅": "遘",
    "遒": "逎",
    "鑪": "鈩鑢",
    "鑽": "鑚",
    "閙": "鬧",
    "闊": "濶",
    "齏": "韲",
    "飄": "飃",
    "鰮": "鰛",
    "鰲": "鼇",
    "鳧": "鳬",
    "鴟": "鵄",
    "鵝": "鵞",
    "鶇": "鶫",
    "鷆": "鷏",
    "麩": "麸",
    "吉": "𠮷",
}
