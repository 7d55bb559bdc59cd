"""Values that results depend on: word lists, weights, thresholds and patterns.

They are fixed: another value gives another result. Patterns are matched without regard to case."""

from __future__ import annotations

#: Words that headlines are compared without.
STOPWORDS = "a an and are as at be by for from has have in into is it its of on or that the this to with will after amid over under says said new update".split()

#: Event classes, the first of which wins.
EVENT_CLASS_ORDER = "fed_action macro_print m_a regulatory earnings guidance product financing corporate_action market_flow trade_policy geopolitical".split()

#: Label to event class.
EVENT_CLASS_MAP = {
    "central_bank": "fed_action",
    "rates": "fed_action",
    "macro": "macro_print",
    "cpi": "macro_print",
    "ppi": "macro_print",
    "payrolls": "macro_print",
    "gdp": "macro_print",
    "m&a": "m_a",
    "merger": "m_a",
    "acquisition": "m_a",
    "earnings": "earnings",
    "guidance": "guidance",
    "regulatory": "regulatory",
    "fda": "regulatory",
    "sec": "regulatory",
    "ftc": "regulatory",
    "doj": "regulatory",
    "financing": "financing",
    "layoffs": "corporate_action",
    "labor": "corporate_action",
    "etf_flow": "market_flow",
    "trade": "trade_policy",
    "tariff": "trade_policy",
    "geopolitical": "geopolitical",
}

#: Text patterns of event classes, the first match of which wins.
EVENT_CLASS_TEXT = [
    (r"\b(?:fomc|federal reserve|ecb|bank of england|boj|pboc|rate (?:cut|hike|hold|decision)|monetary policy)\b", "fed_action"),
    (r"\b(?:cpi|ppi|payrolls|nonfarm|gdp|pce|inflation|unemployment|jobless claims)\b", "macro_print"),
    (r"\b(?:fda|ema|sec|ftc|doj|justice department|antitrust|probe|investigation|lawsuit|sues?|charges?|approv|reject|clearance)\b", "regulatory"),
    (r"\b(?:earnings|eps|revenue|guidance|quarterly results|fiscal year)\b", "earnings"),
    (r"\b(?:forecast|outlook|guidance|raises? (?:its )?forecast|cuts? (?:its )?forecast)\b", "guidance"),
    (r"\b(?:loan|rescue package|financing|debt|equity deal|capital raise|offering|bailout|government owning)\b", "financing"),
    (r"\b(?:layoffs?|job cuts?|freeze roles?|restructur|strike|union)\b", "corporate_action"),
    (r"\b(?:etf|inflows?|outflows?|fund flows?|record assets?|open interest)\b", "market_flow"),
    (r"\b(?:tariff|export controls?|export licen[cs]es?|sanctions?|trade deal|mofcom|customs)\b", "trade_policy"),
    (r"\b(?:ceasefire|missile|drone|war|strikes?|attack|iran|russia|ukraine|strait of hormuz)\b", "geopolitical"),
    (r"\b(?:merger|acquisition|takeover bid|to acquire|will acquire|acquires?|buyout|spin[- ]off|divest)\b", "m_a"),
    (r"\b(?:launches?|releases?|unveils?|introduces?|preview|new model|product)\b", "product"),
]

#: Patterns of events that matter, with weight and label.
HIGH_VALUE = [
    (r"\b(?:reports?|posts?)\s+(?:q[1-4]|first|second|third|fourth)\s+quarter\b", 45, "earnings"),
    (r"\b(?:reports?|posts?)\s+(?:fy|fiscal|full[- ]year|annual)\s+\d{4}\b", 40, "earnings"),
    (r"\bannounces?\s+(?:q[1-4]|first|second|third|fourth)\s+quarter\s+\d{4}\s+(?:financial|operating|operational|results)\b", 40, "earnings"),
    (r"\b(?:eps|earnings per share)\s+of\s*\$", 40, "earnings"),
    (r"\brevenue\s+(?:of|grew|rose|fell|declined|up|down)\b", 35, "earnings"),
    (r"\b(?:sees?|reports?|posts?)\s+(?:sales|revenue|net income|net loss|operating income)\s+(?:decline|growth|grew|fell|rose|up|down|of)\b", 35, "earnings"),
    (r"\b(?:beats?|misses?|tops?)\s+(?:estimates?|expectations?|consensus)\b", 40, "earnings"),
    (r"\b(?:to acquire|will acquire|agrees? to acquire|to be acquired|acquires?|acquisition of)\b", 50, "m_a"),
    (r"\b(?:merger|merge with|stock-for-stock|all-cash deal|tender offer|takeover bid|definitive agreement|plan of arrangement)\b", 45, "m_a"),
    (r"\b(?:divest(?:s|iture)?|spins? off|spin-off|carve-out)\b", 35, "m_a"),
    (r"\b(?:raises?|lifts?|narrows?|lowers?|cuts?)\s+(?:full[- ]year|fy|annual|fiscal|q[1-4])?\s*(?:guidance|outlook|forecast)\b", 45, "guidance"),
    (r"\b(?:withdraws?|suspends?|reaffirms?)\s+guidance\b", 35, "guidance"),
    (r"\b(?:fda)\s+(?:approv|reject|grants?|clears?|clearance|accepts?|authoriz|denies?|withdraws?)", 50, "regulatory"),
    (r"\b(?:fda|ema|mhra|pmda)\s+(?:issues?\s+(?:warning letter|complete response letter|crl)|warning letter to)\b", 55, "regulatory"),
    (r"\b(?:phase\s*[123]|topline)\s+(?:trial|results|data|readout)\b", 40, "regulatory"),
    (r"\b(?:doj|department of justice|sec|ftc|antitrust|consent decree)\s+(?:charges?|sues?|files?|investigation|probe)", 40, "regulatory"),
    (r"\bsec\s+(?:charges?|fines?|sanctions?|settles?|sues?|bars?|orders?\s+(?:disgorgement|penalty))\b", 55, "regulatory"),
    (r"\bftc\s+(?:sues?|bans?|blocks?|challenges?|takes?\s+action|orders?|files?\s+(?:complaint|suit)|secures?)\b", 55, "regulatory"),
    (r"\b(?:doj|justice department|department of justice)\s+(?:sues?|indicts?|charges?|files?\s+(?:civil|criminal|antitrust|complaint)|secures?\s+(?:guilty plea|conviction|settlement))\b", 55, "regulatory"),
    (r"\b(?:antitrust\s+(?:suit|complaint|investigation|probe|enforcement)|monopolization (?:claim|case)|merger challenge|consent decree|deferred prosecution agreement|non-prosecution agreement|fcpa)\b", 55, "regulatory"),
    (r"\bclass\s+i\s+recall\b", 50, "regulatory"),
    (r"\b(?:fda|medwatch)\s+safety\s+(?:alert|communication)\b", 45, "regulatory"),
    (r"\b(?:files? for|prices?|launches?)\s+ipo\b", 35, "ipo"),
    (r"\b(?:secondary offering|direct offering|registered offering)\b.{0,40}(?:million|billion)", 25, "offering"),
    (r"\$\s?\d+(?:\.\d+)?\s*(?:million|billion)\s+(?:contract|order|award|deal|backlog|investment)", 30, "contract"),
    (r"\bawarded\b.{0,40}\$\s?\d+(?:\.\d+)?\s*(?:million|billion)", 30, "contract"),
    (r"\b(?:activist|proxy fight|13d|13d/a|takes?\s+stake|builds?\s+stake)\b", 35, "activist"),
    (r"\b(?:bankruptcy|chapter 11|chapter 7|going concern|delist|delisting|cessation of operations|ceases? operations)\b", 45, "distress"),
    (r"\b(?:recall|investigates?|class\s*i\s+recall|safety alert)\b", 25, "operational"),
    (r"\b(?:stock split|reverse split|share buyback|buyback program|repurchase program)\b.{0,60}(?:million|billion|\$)", 25, "capital_return"),
    (r"\b(?:fomc|federal open market committee)\s+(?:statement|decision|minutes|holds?|cuts?|raises?|leaves?)\b", 55, "fed_action"),
    (r"\b(?:fed|federal reserve|ecb|bank of england|bank of japan|pboc)\b.{0,60}\b(?:cuts?|raises?|holds?|hikes?|decision|statement|policy meeting)\b", 50, "fed_action"),
    (r"\b(?:rate (?:cut|hike|decision|hold)|interest rate (?:cut|hike|decision))\b", 45, "fed_action"),
    (r"\b(?:lagarde|de guindos|powell|bailey|ueda|macklem|lowe|bullock)\b.{0,40}\b(?:monetary policy|policy statement|rate decision|press conference)\b", 45, "fed_action"),
    (r"\bmonetary policy (?:statement|decision|summary)\b", 40, "fed_action"),
    (r"\bbank rate\s+(?:maintained|held|cut|raised|increased|decreased|at\s+\d)", 45, "fed_action"),
    (r"\b(?:cpi|ppi|jolts|empsit|nonfarm payrolls|jobs report)\b.{0,80}\b(?:reports?|report|released|prints?|rises?|falls?|up|down|of\s+\d|grew|declined)\b", 50, "macro_print"),
    (r"\b(?:gdp|pce|personal consumption expenditures)\b.{0,80}\b(?:advance estimate|second estimate|third estimate|preliminary estimate)\b", 50, "macro_print"),
    (r"\bpersonal income and outlays\b", 45, "macro_print"),
    (r"\b(?:cpi|ppi|inflation|unemployment rate|jobless claims|consumer price index|producer price index)\s+(?:rose|fell|grew|declined|up|down|at|of)\b", 50, "macro_print"),
    (r"\b(?:annual energy outlook|petroleum status report|weekly petroleum)\b", 35, "macro_print"),
    (r"\b(?:payroll employment|nonfarm payrolls)\b.{0,80}\b(?:increase|decrease|rise|fall|gain|loss|change|by\s+[\d,]+)\b", 55, "macro_print"),
    (r"\bcpi for all items\b.{0,40}\b(?:rises?|falls?|increases?|decreases?|unchanged|up|down|advances?|declines?)\b", 55, "macro_print"),
    (r"\bppi for final demand\b.{0,40}\b(?:rises?|falls?|increases?|decreases?|unchanged|up|down|advances?|declines?)\b", 55, "macro_print"),
    (r"\bjob openings\b.{0,80}\b(?:increase|decrease|rise|fall|change|little|up|down)\b", 50, "macro_print"),
    (r"\b(?:tariff|section 301|countervailing duty)\b.{0,80}\b(?:imposes?|imposed|lifts?|lifted|increases?|raises?|paused?|exemption|on imports)\b", 45, "tariff_action"),
    (r"\b(?:imposes?|adds?|expands?|lifts?|removes?|extends?)\b.{0,40}\bsanctions?\b", 45, "sanctions"),
    (r"\b(?:added to|placed on|removed from)\s+(?:the\s+)?entity list\b", 45, "sanctions"),
    (r"\b(?:executive order|presidential memorandum)\b.{0,80}\b(?:signed|issued|signs?|issues?|directs?|on)\b", 35, "executive_order"),
    (r"\b(?:raises?|lifts?|cuts?|lowers?|sets?|ups|resets?|revamps?|trims?|boosts?|bumps?)\b.{0,30}\b(?:price\s+target|stock\s+(?:target|forecast)|target|forecast|estimate|outlook|pt)\b", 30, "analyst_action"),
    (r"\b(?:price target|stock\s+forecast|pt|target)\s+(?:raised|lifted|lowered|cut|trimmed|boosted|set|reset|hiked)\b", 30, "analyst_action"),
    (r"\b(?:upgrades?|downgrades?)\b.{0,40}\b(?:to|from)\s+(?:buy|sell|hold|outperform|underperform|overweight|underweight|neutral|market\s+perform|equal\s+weight)\b", 30, "analyst_action"),
    (r"\b(?:initiates?\s+coverage|reiterates?)\b.{0,40}\b(?:buy|sell|hold|outperform|underperform|overweight|underweight)\b", 25, "analyst_action"),
    (r"\b(?:launches?|unveils?|introduces?|debuts?|deploys?|deploy|rolls?\s+out|rolling\s+out)\b.{0,60}\b(?:platform|robots?|operating system|automation|ai\s+(?:platform|system|model))\b", 25, "product_launch"),
    (r"\b(?:industrial|enterprise|autonomous|cloud|edge|next[-\s]?gen(?:eration)?)\s+ai\s+platform\b", 25, "product_launch"),
    (r"\b(?:deploys?|deploy|launches?|rolls?\s+out)\b.{0,30}\b(?:ai|autonomous|ai[-\s]powered)\b.{0,60}\b(?:system|platform|robots?|automation|solution|refrigeration|warehouse|factory|fleet)\b", 25, "product_launch"),
    (r"\b(?:halts?|shuts?\s+down|pauses?|suspends?|idles?)\b.{0,40}\b(?:operations?|production|mining|drilling|refining|output|activity)\b", 35, "operational_disruption"),
    (r"\b(?:fire|explosion|flood|earthquake|hurricane|outage|cyberattack|ransomware|breach)\b.{0,80}\b(?:plant|facility|operations?|production|refinery|mine|terminal|pipeline|data\s+center)\b", 30, "operational_disruption"),
    (r"\b(?:gold|silver|copper|platinum|palladium|brent|wti|crude\s+oil|natural\s+gas|natgas|uranium|oil)\b.{0,40}\b(?:rises?|falls?|surges?|slumps?|drops?|jumps?|climbs?|tumbles?|gains?|loses?|advances?|retreats?|holds?|steady|hovers?|soars?|plunges?|spikes?|rallies|rally|sinks?|trades?\s+(?:up|down|higher|lower)|pushe?[ds]?\s+(?:up|down|higher|lower)|move[ds]?\s+(?:up|down|higher|lower)|hits?\s+(?:high|low|record))\b", 25, "commodity_move"),
    (r"\b(?:gold|silver|copper|brent|wti|crude\s+oil|natural\s+gas)\b.{0,80}\babove\s+\$\s?\d", 25, "commodity_move"),
    (r"\b(?:gold|silver|copper|brent|wti|crude\s+oil|natural\s+gas)\s+prices?\s+(?:today|fall|rise|jump|drop|surge|slump|gain|hold|steady)\b", 25, "commodity_move"),
    (r"\b(?:central banks?|pboc|boj|ecb|federal reserve|reserve bank)\s+(?:tap|taps|tapped|expand|expands?|raise|raises?|reduce|reduces?|increases?|adds?|withdraws?|drains?|accumulate|accumulates?)\b", 25, "central_bank_action"),
    (r"\b(?:de[-\s]?dollarization|currency\s+swap\s+line|swap\s+line|reserve\s+accumulation|sovereign\s+gold|reserve\s+(?:diversification|reallocation))\b", 25, "central_bank_action"),
    (r"\b(?:summit|state visit|g7|g20|apec|asean)\b.{0,80}\b(?:concludes?|wraps?|signed|reached|agreement|deal|ends?)\b", 40, "geopolitical_summit"),
    (r"\b(?:trade deal|trade agreement|trade pact|free trade)\b.{0,60}\b(?:signed|reached|announced|collapses?|fails?|stalls?)\b", 45, "geopolitical_summit"),
    (r"\b(?:president|prime minister|chancellor|premier)\b.{0,40}\b(?:meets?|visits?|holds?\s+talks)\b.{0,60}\b(?:trade|tariff|sanctions?|cooperation|alliance)\b", 35, "geopolitical_summit"),
    (r"\b(?:diplomatic\s+(?:breakthrough|crisis|tension)|(?:diplomatic|bilateral|trade|us[-\s]china|sino[-\s]us|us[-\s]russia)\s+relations?\s+(?:deteriorate|improve|normalize|sour|warm|thaw|collapse)|embassy\s+(?:closure|reopening))\b", 35, "geopolitical_summit"),
    (r"\b(?:iran|russia|israel|ukraine|north\s+korea|venezuela|opec|saudi|houthi|hezbollah)\b.{0,80}\b(?:oil|crude|gas|energy|tanker|pipeline|refinery|nuclear|sanctions?|strike|threat|attack|targets?|ultimatum)\b", 35, "geopolitical_energy"),
    (r"\b(?:oil|crude|gas|energy)\s+prices?\b.{0,80}\b(?:iran|russia|israel|ukraine|opec|saudi|houthi|geopolitical|tension|conflict|war|sanctions?)\b", 35, "geopolitical_energy"),
    (r"\b(?:bond|treasury|sovereign|jgb|gilt|bund)\s+yields?\b.{0,60}\b(?:surge|spike|jump|soar|plunge|tumble|rise|fall|climb|drop|gain|gains|edge|flirt|hit\s+(?:high|low|record|multi[-\s]year)|reset|unhinged)\b", 35, "yield_shock"),
    (r"\b(?:10[-\s]year|30[-\s]year|2[-\s]year|long[-\s]term)\s+(?:yields?|bonds?|treasur(?:y|ies))\b.{0,60}\b(?:surge|spike|jump|soar|plunge|tumble|rise|fall|gain|gains|flirt|hit\s+(?:high|low|record|multi[-\s]year))\b", 35, "yield_shock"),
    (r"\b(?:us|u\.s\.)\s+(?:yields?|treasur(?:y|ies))\b.{0,50}\b(?:gain|gains|rise|fall|flirt|surge|drop|climb)\b", 35, "yield_shock"),
    (r"\bglobal\s+bond\s+(?:selloff|sell[-\s]off|rout|crash|tantrum)\b", 40, "yield_shock"),
    (r"\b(?:port|dock|longshoremen|maritime|shipping)\b.{0,60}\b(?:strike|walkout|work stoppage|shuts?\s+down|closes?|disruption|congestion)\b", 40, "supply_chain_disruption"),
    (r"\b(?:semiconductor|chip|wafer)\b.{0,60}\b(?:shortage|supply\s+(?:constraint|crunch)|allocation|rationing)\b", 35, "supply_chain_disruption"),
    (r"\b(?:export\s+(?:bans?|restrictions?|controls?)|import\s+(?:bans?|restrictions?))\b.{0,60}\b(?:rare\s+earths?|semiconductors?|chips?|wafers?|critical\s+(?:minerals?|materials?)|lithium|cobalt|gallium|germanium|graphite)\b", 45, "supply_chain_disruption"),
    (r"\b(?:rare\s+earths?|rare[-\s]earth|semiconductors?|chips?|critical\s+(?:minerals?|materials?)|lithium|cobalt|gallium|germanium|graphite)\b.{0,80}\b(?:export\s+(?:bans?|restrictions?|controls?|curbs?)|import\s+(?:bans?|restrictions?))\b", 45, "supply_chain_disruption"),
    (r"\brare[-\s]earths?\s+(?:export\s+)?(?:controls?|curbs?|restrictions?|bans?|sanctions?)\b", 45, "supply_chain_disruption"),
    (r"\b(?:semiconductor|chip|wafer|lithium|cobalt|gallium|germanium|graphite|critical[-\s]mineral)\s+export\s+(?:controls?|curbs?|restrictions?|bans?|sanctions?)\b", 45, "supply_chain_disruption"),
    (r"\b(?:suez|panama\s+canal|strait\s+of\s+hormuz|malacca)\b.{0,60}\b(?:blocked|closure|disruption|suspended|restricted)\b", 50, "supply_chain_disruption"),
    (r"\b(?:logistics|freight|container|cargo)\b.{0,60}\b(?:crisis|shortage|disruption|delays?|backlog)\b", 30, "supply_chain_disruption"),
    (r"\b(?:keystone(?:\s+xl)?|nord\s+stream|dakota\s+access|trans[-\s]?mountain|colonial\s+pipeline|(?:oil|gas|natural\s+gas|crude|petroleum|hydrogen|lng)\s+pipeline)\b.{0,60}\b(?:approved|rejected|cancelled|suspended|blocked|operational|online|shutdown|sabotaged|ruptured|leak)\b", 40, "energy_infrastructure"),
    (r"\b(?:refinery|refineries)\b.{0,60}\b(?:shutdown|outage|fire|explosion|capacity|offline|restart|maintenance)\b", 35, "energy_infrastructure"),
    (r"\b(?:strategic\s+petroleum\s+reserve|spr)\b.{0,60}\b(?:release|tap|draw|replenish|purchase)\b", 45, "energy_infrastructure"),
    (r"\b(?:power\s+(?:outage|grid)|blackout|brownout|grid\s+(?:failure|collapse))\b.{0,60}\b(?:affects?|impacts?|millions?|widespread|major)\b", 35, "energy_infrastructure"),
    (r"\b(?:lng|liquefied\s+natural\s+gas)\b.{0,60}\b(?:terminal|facility|export|capacity)\b.{0,60}\b(?:approved|online|operational|delayed|cancelled)\b", 35, "energy_infrastructure"),
    (r"\b(?:s&p|moody'?s|fitch|dbrs)\b.{0,60}\b(?:upgrades?|downgrades?|affirms?|cuts?|raises?|lowers?)\b.{0,60}\b(?:rating|outlook|credit)\b", 40, "credit_event"),
    (r"\b(?:credit\s+rating|debt\s+rating)\b.{0,60}\b(?:upgraded|downgraded|cut|raised|lowered|affirmed)\b", 40, "credit_event"),
    (r"\b(?:debt\s+default|payment\s+default|missed\s+(?:bond|coupon|interest|principal)\s+payment|covenant\s+breach|technical\s+default|defaults?\s+on\s+(?:\S+\s+){0,3}(?:debt|bonds?|notes?|loans?|payments?|obligations?|debentures?))\b", 50, "credit_event"),
    (r"\b(?:cut|reduced|lowered|raised|upgraded|downgraded|falls?|drops?|loses?|slips?)\s+to\s+(?:junk(?:\s+status)?|speculative\s+grade|investment\s+grade)\b", 35, "credit_event"),
    (r"\b(?:opens?|opening|inaugurates?)\b.{0,60}\b(?:factory|plant|facility|manufacturing|production)\b.{0,60}\b(?:billion|million|\$\s?\d)", 35, "capacity_change"),
    (r"\b(?:closes?|closing|shuts?\s+down|shuttering)\b.{0,60}\b(?:factory|plant|manufacturing|production|assembly\s+(?:line|plant)|(?:chemical|semiconductor|fab|foundry|smelter|refinery|mill)\s+facility)\b", 40, "capacity_change"),
    (r"\b(?:expands?|expansion|increases?)\b.{0,60}\b(?:production\s+capacity|manufacturing\s+capacity|output|capacity)\b.{0,60}\b(?:by\s+\d+%|billion|million)", 30, "capacity_change"),
    (r"\b(?:reshoring|onshoring|nearshoring|offshoring|relocat(?:es?|ing))\b.{0,60}\b(?:production|manufacturing|operations?|facility|plant)\b", 35, "capacity_change"),
    (r"\b(?:groundbreaking|breaks\s+ground)\b.{0,60}\b(?:factory|plant|facility|manufacturing|fab|foundry)\b", 30, "capacity_change"),
    (r"\b(?:opec|opec\+|organization\s+of\s+petroleum)\b.{0,60}\b(?:cuts?|increases?|raises?|lowers?|maintains?|agrees?|decision|output|production|quota)\b", 50, "commodity_supply_shock"),
    (r"\b(?:production\s+cut|output\s+cut|supply\s+cut)\b.{0,60}\b(?:opec|oil|crude|barrel)", 45, "commodity_supply_shock"),
    (r"\b(?:crop\s+(?:failure|damage|loss)|harvest|drought|flood|freeze)\b.{0,60}\b(?:corn|wheat|soybean|coffee|cocoa|sugar|cotton|rice)\b", 40, "commodity_supply_shock"),
    (r"\b(?:mine|mining)\b.{0,60}\b(?:closure|shutdown|strike|accident|collapse|suspended|halted)\b.{0,60}\b(?:copper|gold|silver|lithium|cobalt|nickel|zinc|iron\s+ore)\b", 40, "commodity_supply_shock"),
    (r"\b(?:usda|department\s+of\s+agriculture)\b.{0,60}\b(?:crop\s+report|production\s+estimate|harvest|yield)\b", 35, "commodity_supply_shock"),
    (r"\b(?:reserves?|stockpile)\b.{0,60}\b(?:release|draw|tap|depleted|replenish)\b.{0,60}\b(?:oil|petroleum|grain|wheat|corn)\b", 35, "commodity_supply_shock"),
]

#: Patterns of routine notices, with label.
NOISE = [
    (r"\bto\s+(?:present|attend|participate|host|speak)\s+at\b.{0,80}\b(?:conference|summit|symposium|forum|day|investor (?:day|event))\b", "conference"),
    (r"\bwill\s+(?:present|attend|participate)\s+at\b.{0,80}\bconference\b", "conference"),
    (r"\bappoints?\b.{0,80}\bto\b.{0,15}\bboard\b", "board_change"),
    (r"\b(?:appoints?|names?)\s+(?:new\s+)?(?:chief|president|cfo|ceo|cto|coo|chairman|chairperson|chairwoman|director|head of)\b", "officer_change"),
    (r"\b(?:declares?|announces?)\s+(?:quarterly\s+)?(?:cash\s+)?dividend\b", "dividend_routine"),
    (r"\b(?:announces?|announced)\s+pricing of\b.{0,60}\b(?:notes?|debentures?|bonds?)\b", "debt_routine"),
    (r"\bprices?\b.{0,40}\bsenior\s+(?:secured\s+|unsecured\s+)?notes?\b", "debt_routine"),
    (r"\btop\s+\d+\s+amazon\b", "listicle"),
    (r"\b(?:amazon|kindle)\s+(?:bestseller|best[- ]selling|kdp|kindle store)\b", "listicle"),
    (r"\b(?:novel|fiction|memoir|paperback|audiobook)\b.{0,80}\b(?:available|launches?|debuts?|publishes?)\b(?=.{0,400}\b(?:author|publisher|book|kindle|amazon|goodreads|isbn|hardcover|chapters?)\b)", "book_promo"),
    (r"\b(?:wins?|named|recognized as|honored with|receives?)\b.{0,80}\b(?:award|honor|recognition|partner of the (?:year|month|quarter)|best of|top \d+)\b", "award"),
    (r"\bis now available (?:on|at|in|for)\b", "product_routine"),
    (r"\b(?:announces?|launches?)\s+(?:new\s+)?(?:rebate|coupon|promotion|loyalty|sweepstakes|gift card)\b", "promo"),
    (r"\b(?:supports?|sponsors?|partners with|teams up with)\b.{0,80}\b(?:charity|nonprofit|foundation|community|gala|fundraiser)\b", "charity"),
    (r"\b(?:hosts?|holds?)\s+(?:annual\s+)?(?:meeting of (?:the )?(?:share|stock)holders|annual meeting)\b", "agm_routine"),
    (r"\bnotice of (?:annual|special)\s+meeting\b", "agm_routine"),
    (r"\bfiles?\s+(?:form\s+)?(?:10-q|10-k|8-k|s-1|proxy statement)\b", "filing_routine"),
    (r"^(?:fy\s*\d{2,4}\s*q\d|continuing\s+foia|foia\s+(?:education|compliance|training)|administrative\s+appeals|exemption\s+\d|privacy\s+considerations\s+training|procedural\s+requirements)\b", "regulatory_admin"),
    (r"\b(?:advisory committee|small business advisory|investor advisory)\s+to\s+(?:meet|explore|discuss|consider)\b", "regulatory_admin"),
    (r"\bto\s+(?:host|hold)\s+(?:a\s+)?(?:workshop|fireside chat|public meeting|roundtable)\b", "regulatory_admin"),
    (r"\b(?:launches?|introduces?)\s+(?:new\s+)?(?:podcast|newsletter|blog\s+series)\b", "regulatory_admin"),
    (r"\b(?:to\s+)?conclude\s+(?:his|her|their)\s+tenure\b", "regulatory_admin"),
    (r"\bseeks?\s+public\s+comment\s+on\b", "regulatory_admin"),
    (r"\b(?:man|woman|national|alien|resident)\b.{0,80}\b(?:sentenced|pleads?\s+guilty|convicted|charged|arrested|indicted)\b", "individual_crime"),
    (r"\b(?:previously\s+deported|illegal\s+alien|former\s+(?:university\s+)?(?:professor|student|teacher|coach))\b.{0,80}\b(?:sentenced|charged|convicted|guilty)\b", "individual_crime"),
    (r"\bsentenced\s+to\s+\d+\s+(?:months?|years?)\s+(?:in|for)\b", "individual_crime"),
    (r"\b(?:presale|pre-sale)\b.{0,80}\b(?:announces?|raises?|raised|launches?|update|advancement)\b", "crypto_promo"),
    (r"\bprice prediction\b", "crypto_promo"),
    (r"\b(?:might|could|may|expected to|set to|projected to)\s+(?:reach|hit|surge to|rally to|cross|surpass)\s+\$\s?\d", "crypto_promo"),
    (r"^crypto news:\s", "crypto_promo"),
]

#: Headlines that only schedule a report, and macro headlines of first-tier publishers.
SCHEDULING = r"\b(?:to (?:report|release|announce|host|discuss)|will (?:report|release|host|discuss|announce)|schedules?|sets? date|earnings (?:call|release|announcement)\s+(?:date|and|on|scheduled)|earnings release and (?:conference )?call|announces?(?:\s+\w+){0,5}\s+(?:earnings|conference|investor)\s+(?:call|release|webcast)|conference call (?:date|on|scheduled|to discuss))\b"
TIER1_MACRO = r"\b(?:bond\s+yields?|treasury\s+yields?|sovereign\s+yields?|(?:10|30|2)[-\s]year\s+(?:yields?|treasur(?:y|ies))|(?:fed|federal\s+reserve|fomc|ecb|bank\s+of\s+england|boj|inflation|cpi|ppi|monetary\s+policy)|rate\s+(?:cut|hike|decision|expectations?)|us\s+(?:rates?|yields?)|gdp|payrolls|nonfarm)\b"

#: Host, publisher, tier, kind, group of independence, stance.
PUBLISHERS = [
    ("reuters.com", "Reuters", "wire", "news", "reuters", "neutral"),
    ("apnews.com", "AP", "wire", "news", "ap", "neutral"),
    ("ap.org", "AP", "wire", "news", "ap", "neutral"),
    ("afp.com", "AFP", "wire", "news", "afp", "neutral"),
    ("finance.yahoo.com", "Yahoo Finance", "aggregator", "news", "yahoo", "neutral"),
    ("marketwatch.com", "MarketWatch", "tier1", "news", "dow-jones", "neutral"),
    ("wsj.com", "WSJ", "tier1", "news", "dow-jones", "neutral"),
    ("dj.com", "WSJ", "tier1", "news", "dow-jones", "neutral"),
    ("barrons.com", "Barron's", "tier1", "news", "dow-jones", "neutral"),
    ("ft.com", "Financial Times", "tier1", "news", "ft", "neutral"),
    ("cnbc.com", "CNBC", "tier1", "news", "cnbc", "neutral"),
    ("bloomberg.com", "Bloomberg", "tier1", "news", "bloomberg", "neutral"),
    ("economist.com", "The Economist", "tier1", "news", "economist", "neutral"),
    ("nytimes.com", "NYT", "tier1", "news", "nyt", "neutral"),
    ("washingtonpost.com", "The Washington Post", "tier1", "news", "washington-post", "neutral"),
    ("bbc.com", "BBC", "tier1", "news", "bbc", "neutral"),
    ("bbc.co.uk", "BBC", "tier1", "news", "bbc", "neutral"),
    ("bbci.co.uk", "BBC", "tier1", "news", "bbc", "neutral"),
    ("theguardian.com", "The Guardian", "tier1", "news", "guardian", "neutral"),
    ("axios.com", "Axios", "tier1", "news", "axios", "neutral"),
    ("politico.com", "Politico", "tier1", "news", "politico", "neutral"),
    ("investors.com", "Investor's Business Daily", "tier2", "news", "ibd", "neutral"),
    ("benzinga.com", "Benzinga", "tier2", "news", "benzinga", "neutral"),
    ("theinformation.com", "The Information", "trade", "news", "the-information", "neutral"),
    ("asia.nikkei.com", "Nikkei Asia", "tier1", "news", "nikkei", "neutral"),
    ("nikkei.com", "Nikkei", "tier1", "news", "nikkei", "neutral"),
    ("scmp.com", "South China Morning Post", "tier1", "news", "scmp", "neutral"),
    ("prnewswire.com", "PR Newswire", "wire", "pr_wire", "prnewswire", "neutral"),
    ("globenewswire.com", "GlobeNewswire", "wire", "pr_wire", "globenewswire", "neutral"),
    ("businesswire.com", "Business Wire", "wire", "pr_wire", "businesswire", "neutral"),
    ("accesswire.com", "ACCESS Newswire", "wire", "pr_wire", "accesswire", "neutral"),
    ("accessnewswire.com", "ACCESS Newswire", "wire", "pr_wire", "accesswire", "neutral"),
    ("federalreserve.gov", "Federal Reserve", "wire", "central_bank", "federal-reserve", "neutral"),
    ("bea.gov", "BEA", "wire", "regulator", "bea", "neutral"),
    ("bls.gov", "BLS", "wire", "regulator", "bls", "neutral"),
    ("ecb.europa.eu", "ECB", "wire", "central_bank", "ecb", "neutral"),
    ("eia.gov", "EIA", "wire", "regulator", "eia", "neutral"),
    ("bankofengland.co.uk", "Bank of England", "wire", "central_bank", "bank-of-england", "neutral"),
    ("rba.gov.au", "RBA", "wire", "central_bank", "rba", "neutral"),
    ("fda.gov", "FDA", "wire", "regulator", "fda", "neutral"),
    ("sec.gov", "SEC", "wire", "regulator", "sec", "neutral"),
    ("ftc.gov", "FTC", "wire", "regulator", "ftc", "neutral"),
    ("justice.gov", "DOJ", "wire", "regulator", "doj", "neutral"),
    ("digitimes.com", "DigiTimes Asia", "trade", "news", "digitimes", "neutral"),
    ("eetimes.com", "EE Times", "trade", "news", "ee-times", "neutral"),
    ("anandtech.com", "AnandTech", "trade", "news", "anandtech", "neutral"),
    ("defensenews.com", "Defense News", "trade", "news", "defense-news", "neutral"),
    ("breakingdefense.com", "Breaking Defense", "trade", "news", "breaking-defense", "neutral"),
    ("news.usni.org", "USNI News", "trade", "news", "usni", "neutral"),
    ("statnews.com", "STAT News", "trade", "news", "stat", "neutral"),
    ("fiercepharma.com", "FiercePharma", "trade", "news", "fiercepharma", "neutral"),
    ("biopharmadive.com", "BioPharma Dive", "trade", "news", "biopharma-dive", "neutral"),
    ("oilprice.com", "OilPrice", "trade", "news", "oilprice", "neutral"),
    ("mining.com", "Mining.com", "trade", "news", "mining-com", "neutral"),
    ("theblock.co", "The Block", "trade", "news", "the-block", "neutral"),
    ("coindesk.com", "CoinDesk", "trade", "news", "coindesk", "neutral"),
    ("decrypt.co", "Decrypt", "trade", "news", "decrypt", "neutral"),
    ("autonews.com", "Automotive News", "trade", "news", "automotive-news", "neutral"),
    ("electrek.co", "Electrek", "trade", "news", "electrek", "neutral"),
    ("insideevs.com", "InsideEVs", "trade", "news", "insideevs", "neutral"),
    ("cnevpost.com", "CnEVPost", "trade", "news", "cnevpost", "neutral"),
    ("freightwaves.com", "FreightWaves", "trade", "news", "freightwaves", "neutral"),
    ("gamedeveloper.com", "Game Developer", "trade", "news", "game-developer", "neutral"),
    ("chinadaily.com.cn", "China Daily", "tier2", "news", "china-daily", "state_media"),
]

#: Widely held symbols.
MAINSTREAM_SYMBOLS = """
^BSESN ^DJI ^GSPC ^IXIC ^NSEI ^TNX ^VIX BZ=F CL=F DX-Y.NYB DXY EURUSD=X GC=F JPY=X NG=F USDJPY ARKB DFEN DXJ EWJ EWU FBTC FXY GBTC GDX GLD
IBIT PFIX QQQ SMH SPY TLT TMV UNG URA USO XLE BTC BTC-USD ETH-USD COIN 005930.KS 600346.SS 9684.T AAPL ADP AEM AMD AMZN APD APLD ARM AVAV
AVGO BA BA.L BR BRK-B BSX CAG CAVA CCI CCJ CEG CNI CNR CP CRM CRSP CSCO CTRA CTSH DE DELL DIS DNOW DUOL DVN EBAY EFX EMR ESLT EXPO F FANG
FANUY FHN FTAI GEV GIB GIB.A GM GME GOOG GOOGL HIMS HLAG.DE HPE IBM INTC JBLU KBR KO KR KTOS LLY LMT LUV LYSDY META MHK MP MSFT MU NCLH NEM
NNE NOC NOW NTDOY NVDA NVO NYT ON ORCL OXY PANW PEP PINS PLTR POWL PSN RHM.DE RIG ROK SONY SSNLF STZ TCOM TD TEAM TRI TSLA TSM TSN V VNO
VTRS WBD WYNN XOM
""".split()

#: Event classes that a single source can carry.
SINGLE_SOURCE_CLASSES = "analyst_action commodity_move corporate_action earnings fed_action financing geopolitical guidance m_a macro_print market_flow regulatory trade_policy".split()

#: Regions.
REGIONS = "north_america europe uk japan china asia_ex_china australasia latam middle_east africa global".split()

#: Sectors and their parts.
SECTORS = {
    "technology": "semiconductor software internet consumer_electronics ai_infrastructure cybersecurity".split(),
    "financials": "banks insurance asset_managers exchanges fintech".split(),
    "energy": "oil_gas renewables utilities uranium".split(),
    "industrials": "aerospace_defense transportation machinery construction".split(),
    "healthcare": "biotech pharma medtech healthcare_services".split(),
    "materials": "metals_mining chemicals critical_minerals".split(),
    "consumer": "consumer_discretionary consumer_staples luxury autos".split(),
    "real_estate": "reits homebuilders".split(),
    "communication": "telecom media gaming".split(),
    "crypto": "bitcoin ethereum defi stablecoins".split(),
    "macro": "rates fx commodities trade_policy sovereign_credit".split(),
}

#: Other names of sectors.
SECTOR_ALIASES = {
    "aerospace": "industrials.aerospace_defense".split(),
    "agriculture": "consumer.consumer_staples".split(),
    "artificial intelligence": "technology.ai_infrastructure".split(),
    "automotive": "consumer.autos".split(),
    "aviation": "industrials.transportation".split(),
    "commodities": "macro.commodities".split(),
    "consumer discretionary": "consumer.consumer_discretionary".split(),
    "consumer electronics": "technology.consumer_electronics".split(),
    "consumer staples": "consumer.consumer_staples".split(),
    "cryptocurrency": "crypto.bitcoin crypto.ethereum".split(),
    "cybersecurity": "technology.cybersecurity".split(),
    "defense": "industrials.aerospace_defense".split(),
    "energy": "energy.oil_gas".split(),
    "oil & gas": "energy.oil_gas".split(),
    "oil and gas": "energy.oil_gas".split(),
    "financial services": "financials.banks".split(),
    "geopolitics": "macro.trade_policy".split(),
    "government & policy": "macro.trade_policy".split(),
    "healthcare": "healthcare.healthcare_services".split(),
    "industrials": "industrials.machinery".split(),
    "international trade": "macro.trade_policy".split(),
    "legal": "macro.trade_policy".split(),
    "macro": "macro.rates".split(),
    "materials": "materials.metals_mining".split(),
    "media & entertainment": "communication.media".split(),
    "national security": "industrials.aerospace_defense".split(),
    "real estate": "real_estate.reits".split(),
    "retail": "consumer.consumer_discretionary".split(),
    "semiconductors": "technology.semiconductor".split(),
    "technology": "technology.software".split(),
    "transportation & logistics": "industrials.transportation".split(),
    "travel & tourism": "consumer.consumer_discretionary".split(),
}
#: Headlines of law firms that look for plaintiffs.
LAWYER_SPAM = r"\b(class action|securities fraud|lead plaintiff|investors? have opportunity|investors who lost|deadline:|encourages .* investors?|rosen,|robbins geller|glancy prongay|bragar eagel|schall law)\b"

#: Words that are no names, names and symbols that are not sought in texts, classes whose single words are common ones.
GATE_STOPWORDS = "de la le les el los et and or the of in on a an as is at to for by from und der die das los las".split()
ALIASES_DENIED = ["nasdaq", "nyse", "amex", "otcqb", "otcqx", "tsx", "tsxv", "lse", "asx", "hkex", "jse", "parsons"]
SYMBOLS_DENIED = ["PSN"]
PROXY_CLASSES = ["commodity", "fx", "rate"]

#: An exchange and its ticker; matched with regard to case.
EXCHANGE_TICKER = r"\b(?:NASDAQ|Nasdaq|NYSE|AMEX|NYSE\s*American|OTCQB|OTCQX|TSX|TSXV|TSX-V|CSE|LSE|FWB|HKEX|ASX|JSE|FRA|EPA|BVMF|BME|SIX)\s*[:\-]\s*([A-Z][A-Z0-9\.\-]{0,6})"

#: Macro phrases, found anywhere in lower-cased text.
MACRO_KEYWORDS = [
    "fed ", "fomc", "federal reserve", "federal open market committee", "rate cut", "rate hike", "interest rate", "monetary policy", "discount rate",
    "balance sheet", "cpi", "ppi", "inflation", "payrolls", "nonfarm", "jobs report", "jobless claims", "unemployment", "gdp", "recession",
    "pce inflation", "personal income", "personal outlays", "treasury yield", "10-year yield", "treasuries", "bond yield", "us dollar", "dollar index",
    "ecb", "european central bank", "governing council", "bank of england", "boe ", "bank of japan", "boj ", "people's bank of china", "pboc",
    "oil prices", "crude oil", "wti crude", "brent crude", "gold prices", "spot gold", "natural gas prices", "petroleum", "energy outlook", "opec",
    "production cut", "energy information administration", "eia ", "tariff", "section 301", "countervailing duty", "trade deficit", "sanctions", "ofac",
    "entity list", "export controls", "executive order", "presidential memorandum", "fda approves", "fda clears", "fda authorizes", "fda grants",
    "fda accepts", "fda rejects", "fda warning letter", "complete response letter", "advisory committee meeting", "sec charges", "sec settles",
    "sec fines", "sec sues", "sec bars", "sec adopts", "sec proposes", "ftc sues", "ftc bans", "ftc blocks", "ftc challenges", "ftc orders",
    "ftc takes action", "justice department", "doj indicts", "doj charges", "doj sues", "antitrust suit", "antitrust complaint", "consent decree",
    "deferred prosecution", "fcpa", "class i recall", "medwatch", "safety communication", "payroll employment", "cpi for all items",
    "ppi for final demand", "job openings", "total separations", "consumer price index", "producer price index",
]

#: Commodity phrases and the symbols that stand for them.
COMMODITY_PROXIES = [
    (r"\bgold\b.{0,40}\b(?:price|prices|spot|surges?|slips?|slipped|falls?|fell|rises?|rose|drops?|dropped|jumps?|jumped|steady|tumbles?|hits?|climbs?|climbed|hovers?|holds?|held|above|below|ounce|bullion)\b", ["GC=F", "GLD", "GDX"]),
    (r"\b(?:crude\s+oil|oil\s+prices?|wti\s+crude|wti\b)\b", ["CL=F", "USO", "XLE"]),
    (r"\bbrent\s+(?:crude|oil)\b", ["BZ=F"]),
    (r"\b(?:natural\s+gas|natgas)\b", ["NG=F", "UNG"]),
]

#: Numbers of the rules for materiality, routing, admission and clustering.
PR_WIRE_CAP, TIER1_MACRO_FLOOR, NO_MATCH_SCORE, HEADLINE_BONUS = 45, 30, 15, 5
STRICT_HOURS, RELAXED_HOURS = 48, 168
REASON_ORDER = ["R0c", "R0b", "R0", "R1", "R2b", "R2", "R4", "R7", "R8", "R5", "R6", "R3"]
AUTOPROMOTE_CLASSES = ["fed_action", "macro_print"]
SHARP_CLASSES = ["fed_action", "macro_print", "m_a", "regulatory"]
DIVERSITY_START, DIVERSITY_SHARE, SYNTHESIS_BUDGET = 20, 0.60, 40
CHEAP_ATTACH, EMBEDDING_ATTACH, COHERENCE = 0.60, 0.70, 0.55
CENTROID_SCAN, PROMOTION_MATERIALITY = 100, 25

#: Numbers of the feed.
HALF_LIFE_HOURS = {"story": 14.0, "x": 32.0}
FEED = {"story_base": 0.45, "per_publisher": 0.05, "publisher_cap": 4, "x_base": 0.25, "per_heat": 0.09, "trend": 0.25, "trend_span": 60, "judged": 0.35, "ticker": 0.25, "sector": 0.10, "hit_cap": 2, "affinity_cap": 0.45}
FEED_WINDOWS = {"ticker_slots": 10, "ticker_cap": 2, "social_slots": 5, "social_cap": 2}

#: Words that a belief doesn't use, and what a target price follows.
BANNED_WORDS = [
    "compress", "compresses", "compressed", "compressing", "compression", "re-rate", "re-rates", "re-rated", "re-rating", "repricing", "reprice", "repriced",
    "structural", "structurally", "valuations", "valuation", "outperformance", "underperformance", "divergence", "diverging", "spillover", "spillovers",
    "convergence", "converging", "elevated", "headwinds", "tailwinds", "secular", "multiples", "broadens", "broaden", "broadening", "unwind", "unwinding",
]
TARGET_PHRASES = ["above", "below", "past", "to", "toward", "towards", "reach", "reaches", "hits", "hit", "breaks", "break", "tops", "top"]
#: Amounts in dollars, and numbers behind a word of a target (fixed values).
DOLLAR_AMOUNT = r"(?i)(\$\d[\d,\.]*(?:\s*(?:K|M|B|T|trillion|billion|million)\b)?)"
TARGET_AMOUNT = rf"(?i)(\b(?:{'|'.join(TARGET_PHRASES)})\s+\$?\d[\d,\.]*\s*(?:%|bps|bp)?\b)"

#: Phrases of the calendar, and a number as data.
TEMPORAL = r"\b(today|yesterday|this morning|overnight|last night|tonight|this week|last week|earlier today)\b"
DATAPOINT = r"\$?\d[\d,]*\.?\d*(?:%|bp|bps)?"

#: Regions, vendor forms and classes of symbols, and a ticker named in a text.
SUFFIX_REGIONS = [(".AX", ["australasia"]), (".T", ["japan"]), (".L", ["uk"]), (".PA", ["europe"]), (".DE", ["europe"]), (".MI", ["europe"]), (".AS", ["europe"]), (".HK", ["china"]), (".SS", ["china"]), (".SZ", ["china"]), ("=X", ["global", "north_america"]), ("=F", ["global"])]
VENDOR_FUTURES = {"GC=F": "GOLD", "CL=F": "WTI", "BZ=F": "BRENT", "NG=F": "NATURAL_GAS"}
VENDOR_SUFFIXES = [(".KS", ".KO"), (".T", ".TSE"), (".L", ".LSE"), (".DE", ".XETRA"), (".SS", ".SHG"), (".ME", ".MCX"), (".HK", ".HK"), (".PA", ".PA"), (".AS", ".AS"), (".MI", ".MI")]
VENDOR_COINS = ["USD", "BTC", "ETH", "USDT", "BNB"]
MACRO_CLASSES, OTC_PINK = ["equity_index", "rate", "vol", "commodity", "fx"], "^[A-Z]{4}[FY]$"
EXPLICIT_TICKER = r"(?:\$\s*|(?:NASDAQ|NYSE|NYSEARCA|AMEX|ASX|LSE|TSE|OTCMKTS)\s*:\s*)([A-Z][A-Z0-9.\-]{0,12}(?:=[A-Z])?)"
SLATE_SIZE, SLATE_BODY, SLATE_ALIAS = 60, 6000, 4
RELATIONS, LOCKED_CONFIDENCE, BRIEF_HOURS = ["supports", "stresses", "unrelated"], 0.70, 48

#: Rules of health (fixed values): code, severity, metric, comparison, threshold, second threshold, other metric, guard metric, guard comparison, guard threshold.
#: ``outside`` has two thresholds; ``below`` and ``differs`` compare with another metric; a guard has to hold as well.
HEALTH_RULES = [
    ("pipeline.no_runs", "critical", "pipeline.run_age_minutes", "missing", None, None, None, None, None, None),
    ("pipeline.stale", "critical", "pipeline.run_age_minutes", ">", 1440.0, None, None, None, None, None),
    ("pipeline.consecutive_failures", "critical", "pipeline.run_failures", ">=", 2.0, None, None, None, None, None),
    ("firehose.no_runs", "critical", "firehose.age_minutes", "missing", None, None, None, None, None, None),
    ("firehose.stale", "critical", "firehose.age_minutes", ">", 30.0, None, None, None, None, None),
    ("firehose.consecutive_failures", "critical", "firehose.failures", ">=", 2.0, None, None, None, None, None),
    ("firehose.zero_raw_items", "critical", "firehose.raw_items", "==", 0.0, None, None, "firehose.age_minutes", "present", None),
    ("trending.fetch_failed", "critical", "trending.ok", "==", 0.0, None, None, None, None, None),
    ("trending.fetch_failed", "critical", "trending.failures", ">=", 1.0, None, None, "trending.ok", "present", None),
    ("trending.stale", "warn", "trending.age_minutes", ">", 2880.0, None, None, "trending.ok", "present", None),
    ("social.fetch_failed", "critical", "social.ok", "==", 0.0, None, None, None, None, None),
    ("social.fetch_failed", "critical", "social.failures", ">=", 1.0, None, None, "social.ok", "present", None),
    ("social.stale", "warn", "social.age_minutes", ">", 2880.0, None, None, "social.ok", "present", None),
    ("route_funnel.missing", "warn", "route_funnel.evaluated", "missing", None, None, None, "pipeline.run_ok", "==", 1.0),
    ("route_funnel.zero_promotes", "warn", "route_funnel.promotes", "==", 0.0, None, None, "route_funnel.evaluated", ">=", 100.0),
    ("route_funnel.high_synth_reject_rate", "warn", "route_funnel.reject_rate", ">=", 0.5, None, None, "route_funnel.admitted", ">=", 5.0),
    ("route_funnel.low_story_good_rate", "warn", "route_funnel.good_rate", "<", 0.4, None, None, "route_funnel.stories_judged", ">=", 5.0),
    ("news.no_news_24h", "critical", "news.total_24h", "==", 0.0, None, None, None, None, None),
    ("news.sharp_empty_sector_rate_high", "warn", "news.sharp_empty_sector_rate", ">", 0.2, None, None, None, None, None),
    ("news.ticker_coverage_low", "warn", "news.missing_ticker_rate", ">", 0.5, None, None, "news.total_24h", ">", 0.0),
    ("story.none", "critical", "story.age_minutes", "missing", None, None, None, None, None, None),
    ("story.stale", "critical", "story.age_minutes", ">", 540.0, None, None, None, None, None),
    ("story.embedding_gap", "warn", "story.missing_embeddings_24h", ">", 0.0, None, None, None, None, None),
    ("thesis.missing_match_chunks", "critical", "thesis.without_chunks", ">", 0.0, None, None, None, None, None),
    ("thesis.no_links", "warn", "thesis.without_links", ">", 0.0, None, None, None, None, None),
    ("thesis.stuck_candidates", "warn", "thesis.stuck_7d", ">", 0.0, None, None, None, None, None),
    ("matches.no_updates", "critical", "matches.updated_24h", "==", 0.0, None, None, "story.stories_24h", ">", 0.0),
    ("matches.judge_failures", "warn", "matches.judge_failures", ">", 0.0, None, None, None, None, None),
    ("matches.theses_failed", "critical", "matches.theses_failed", ">", 0.0, None, None, None, None, None),
    ("scoring.snapshots_missing", "critical", "scoring.snapshots_today", "below", None, None, "scoring.scoreable", None, None, None),
    ("scoring.null_scores", "critical", "scoring.null_scores", ">", 0.0, None, None, None, None, None),
    ("scoring.null_tailwind", "warn", "scoring.null_tailwind", ">", 0.0, None, None, None, None, None),
    ("brief.missing", "critical", "brief.day", "missing", None, None, None, None, None, None),
    ("brief.not_today", "warn", "brief.day", "differs", None, None, "pipeline.expected_day", "brief.day", "present", None),
    ("brief.theme_count_invalid", "critical", "brief.themes", "outside", 4.0, 6.0, None, "brief.day", "present", None),
    ("brief.no_sources", "critical", "brief.sources", "==", 0.0, None, None, "brief.day", "present", None),
    ("brief.themes_without_sources", "critical", "brief.themes_without_sources", ">", 0.0, None, None, "brief.day", "present", None),
    ("pending_instruments.backlog_high", "warn", "pending.unreviewed", ">", 250.0, None, None, None, None, None),
    ("agent_usage.errors", "critical", "usage.errors_24h", ">", 0.0, None, None, "usage.available", "==", 1.0),
    ("agent_usage.missing_session_id", "warn", "usage.missing_session_24h", ">", 0.0, None, None, "usage.available", "==", 1.0),
    ("agent_usage.zero_cost_tokens", "critical", "usage.zero_cost_tokens_24h", ">", 0.0, None, None, "usage.available", "==", 1.0),
    ("agent_usage.missing_aggregate", "critical", "usage.missing_aggregate_24h", ">", 0.0, None, None, "usage.available", "==", 1.0),
]
#: Social topics (fixed values): least heat, new topics a day, least and most cited posts, hours that a topic lives, share of the shorter title that makes a duplicate; stances; the id in a post's address.
SOCIAL = {"heat": 4, "daily": 20, "posts_least": 3, "posts_most": 6, "live_h": 48, "same_title": 0.55}
STANCES = ["bull", "bear", "neutral"]
POST_ID = r"/status/(\d+)"
#: Bars of a view (fixed values): width, bars shown, days looked back, days looked back with a warm-up.
TIMEFRAMES = {"1d": ("5 minutes", 78, 5, 12), "1w": ("1 hour", 40, 15, 45), "1mo": ("1 day", 22, 35, 300), "1yr": ("7 days", 52, 420, 1825)}
#: Days and hours of the feed (fixed values): a story is a candidate for 72 hours unless its label is one of these, a social item for 48.
FEED_HOURS, FEED_LABELS_OUT = {"story": 72, "x": 48}, ["unclear", "no_value"]
#: What a thesis' card says (fixed values).
PRESCRIPTIONS = {"review": "Review or restate.", "challenged": "Holding, but one signal is challenging.", "holding": "Holding. Let it run.", "trending": "Watch. One invalidation is trending.", "watch": "Watch."}
