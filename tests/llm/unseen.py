"""Sentences written for these tests, none of them from the test tables: what the operators of problems 5 and 8 meet elsewhere."""

ABUSE = (
    "You are a complete moron and everyone here knows it.", "I will kill you when you leave the office.", "Shut up, you stupid bitch.", "Go die in a fire, nobody would miss you.", "Rot in hell, you miserable coward.",
    "You're such an idoit, delete your account.", "i'm gonna break your legs", "Hang yourself already.", "You worthless piece of trash.", "What an absolute scumbag you are.", "Kill yourself, loser.",
    "我要砍死你们全家", "你这个蠢猪给我滚", "你们全家早点死光", "你真是个不要脸的东西", "再敢来老子打断你的狗腿", "闭嘴吧你个智障", "你脑子进水了吧，废物", "老子今晚就弄死你", "你就是个傻*逼",
    "Immigrants are vermin and should be wiped out.", "Those people are nothing but filthy parasites.", "These foreigners are subhuman scum.", "They are savages and always will be.", "All of them should be gassed.",
    "那帮外地人全是蟑螂", "这群移民就是寄生虫，统统该死", "那种人天生低等", "他们都是畜生，不配活着", "把这些难民都灭光",
    "Hot singles want to fuck you tonight, click here.", "Watch free porn videos with busty teens.", "She spread her legs and he thrust into her.", "Horny milfs in your area, send nudes.", "xxx cams live, naked girls waiting",
    "同城约炮，全套服务，加微信", "免费看黄片，无码高清", "裸聊妹子在线等你", "上门服务，包夜八百", "他把手伸进她的内裤里揉捏",
)
CLEAN = (
    'He testified that the man shouted "go kill yourself" at him.', 'The report quotes a post saying "you are a complete moron", which was removed.', "“你这个废物”是这起案件中被反复引用的一句话。", "法院认定，被告曾对原告喊“弄死你”，构成威胁。",
    "Stress can kill you slowly if you never rest.", "The compiler kills the process and you lose the session.", "We need to cut the dead wood from the portfolio.", "The idiot-proof installer works well.", "They are animals that hibernate in winter.",
    "Parasites are common in tropical freshwater.", "Rats are social and learn quickly.", "The museum shows naked figures from antiquity.", "Sexual health education should begin early.", "Breast cancer screening saves lives.",
    "The clown fish lives among anemones.", "Take out the trash on Monday.", "You can trash the old files safely.", "The loser of the match pays for dinner.", "Bastard files are handled by the linker script.", "A junk bond trades below par.",
    "垃圾分类从今天开始实施。", "废物利用可以降低成本。", "这只股票跌得很惨，大家注意止损。", "你可以在设置里删除不要的东西。", "寄生虫病防治手册发布。", "蟑螂是常见的家庭害虫。", "畜生道是佛教六道之一。", "性教育课程进入中学。",
    "进程卡住时可以先 kill 掉再重启。", "你的方法比我的好。", "如果你不同意，请说明理由。", "敏感词列表：白痴、废物、人渣。", "审核规则会拦截“去死吧”之类的留言。", "他们是一群志愿者。", "移民政策需要更多讨论。", "Immigrants are welcome in this city.",
    "Those people are our neighbours.", "You are right about the moron test in the old psychology paper.", "The word idiot comes from Greek.", "Please stop using the term retard in commit messages.",
)

RESIDUE = (
    "Please switch JavaScript on to use this website.", "The server encountered a temporary error and could not complete your request.", "该文章已不存在", "页面加载失败，请检查网络后再试", "Dear [INSERT COMPANY NAME],\nThank you for your order.",
    "Hi {name}, welcome back to our newsletter!", "Sorry, the page you are looking for does not exist.", "Error 500: something went wrong. Please refresh.", "This content requires JavaScript to be enabled in your browser.", "您的浏览器不支持脚本，请更换浏览器",
    "抱歉，您请求的页面无法找到", "系统维护中，请稍后访问", "[YOUR NAME HERE]", "{{ user.first_name }}，您好", "Posted by %AUTHOR% on %DATE%", "（此处添加正文）", "正文正文正文正文正文正文", "xxxxxx xxxxxx xxxxxx xxxxxx", "Insert your text here. Insert your text here.",
    "Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia.", "TBD TBD TBD", "标题待定\n作者：XXX", "Dear <FIRST NAME>, your subscription expires on <DATE>.", "内容正在加载，请开启脚本", "Access to this page has been denied.", "网站暂时无法访问，请稍后重试",
    "您没有权限查看该内容", "本文已被作者删除", "$title$ - $date$", "Hello ${customer_name}, your invoice is attached.",
)
CONTENT = (
    "JavaScript powers most of the interactive web, and you can switch it on or off in the browser settings for testing.", "Our server returned a 404 error rate of 2% last quarter, which we fixed by adding redirects. The rest of this post explains how.", "Use the variable {name} in the template to greet the reader.",
    "In Python, f\"Hi {name}\" formats a string.", "The template engine replaces {{ title }} with the real title.", "他在文章里讨论了页面加载失败的常见原因，并给出了三种排查方法。", "我们把 `${nickname}` 换成用户昵称。", "短文。", "价格区间 [100, 200] 之间。", "集合 {1, 2, 3} 的元素有三个。",
    "见文献[12]与[INSERT]语句的区别。", "数据库的 INSERT 语句写法如下。", "The page does not exist in the first edition, but the second edition adds it together with a long commentary on the text.", "维护系统时请先备份，再更新补丁，最后检查日志。", "C# 的 <T> 表示泛型参数。", "命令 ls *.md 会列出所有文件。",
    "He waited for the page to load, then wrote down what the error said and called support about it the next day.", "动量因子在三月回撤百分之五。", "收益率曲线 $r_t = a + b x_t$ 很平坦。", "请稍后再试这道菜：先腌两小时，再下锅。",
)

#: Written after the lexicons were widened to the sentences above: none of these was seen before they were fixed.
ABUSE_AFTER = (
    "You're a disgusting pig and I hope you die alone.", "We're going to find out where you live and hurt you.", "What a bunch of retards you are.", "Nobody likes you, you ugly freak.", "滚开，你这条疯狗", "我迟早杀了你全家", "你妈怎么生出你这种畜生",
    "女人都是祸害", "Refugees are just parasites.", "These people should be exterminated.", "Slutty housewives waiting for you", "高清成人电影免费下载", "她脱光了骑在他身上", "Eat a bullet, moron.",
)
CLEAN_AFTER = (
    "The pigs are fed twice a day.", "Women are more likely to invest in bonds.", "He called the judge an idiot in his memoir.", "The teacher explained why 'retard' is offensive.", "他骂我是白痴，我没有理他。", "Die casting is a process for metal parts.", "Kill the daemon and restart it yourself.",
    "她伸手去拿桌上的书。", "高清地图服务已经上线。", "这群人是来帮忙的。", "You are going to love this recipe.", "Hot models of memory chips sold out.", "你全家福拍得真好。", "一群羊在山坡上吃草。",
)
