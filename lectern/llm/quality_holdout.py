"""Short texts whose kinds were checked by hand, on which the classifier's probabilities are calibrated."""

HOLDOUT: list[tuple[str, str]] = [
    ("We study how readers find answers in long reports. The method is simple: each report is cut into parts, and every part is ranked. On two sets it is better than the baseline.", "prose"),
    ("Die Methode ist einfach. Jeder Text wird in Teile zerlegt, und die Teile werden nach ihrem Wert geordnet. Wir zeigen, dass das Ergebnis besser ist.", "prose"),
    ("Nous montrons que la méthode est simple. Le texte est coupé en parties, et chaque partie est classée. Les résultats sont dans le tableau suivant.", "prose"),
    ("Se observa que el modelo es útil. El texto se divide en partes y cada parte se ordena. No hay más que un error en la prueba.", "prose"),
    ("我们提出了一种新的方法。该方法在两个数据集上都很有效。为什么它比基准更好？我们在下一节给出了解释。", "prose"),
    ("この方法は簡単である。文書は短い部分に分けられ、各部分が順位付けされる。なぜこの方法が良いのかを次の節で説明する。", "prose"),
    ("Мы видим, что метод прост. Каждый текст делится на части, и для них считается оценка. Этот метод не хуже базового.", "prose"),
    ("यह विधि सरल है। हम हर पाठ को भागों में बाँटते हैं और उन्हें क्रम देते हैं। यह पहले से बेहतर है।", "prose"),
    ("เราพบว่าวิธีนี้ง่าย เอกสารที่ยาวจะถูกแบ่งเป็นส่วน และคำตอบในแต่ละส่วนจะถูกจัดอันดับ วิธีนี้ไม่ช้า", "prose"),
    ("إن هذه الطريقة بسيطة في كل نص. لا نرى أن الخطأ كبير حتى في السؤال الطويل. هل يمكن ثم تحسين الطريقة؟", "prose"),
    ("> It is often said that the longer\n> text is harder to read, and that the\n> reader gives up before the end. We\n> find that this is not so.", "prose"),
    ("The paper has three parts and an\n appendix. In the first of them we\n give the notation that is used in\n the rest of the text. The proofs are\n in the last part.", "prose"),
    ("4 Results\nThe model is better than the baseline on all of the tasks. As the data grows, the gap is smaller.\n\nIt is not clear why. We leave this for later work.", "prose"),
    ("Our tools are:\n- a parser\n- an index\n\nThe parser reads each page and finds the parts of it that are text. The index is built from these parts, and it is kept on disk so that it can be used again by the next run of the system.", "prose"),
    ("- dense retrieval\n- sparse index\n- late fusion\n- query rewriting\n- answer checking\n- hard negatives", "list"),
    ("1. encoder\n2. decoder block\n3. pooling layer\n4. margin loss\n5. beam search\n6. greedy search\n7. stop list", "list"),
    ("[1] A. Smith, B. Jones. Ranking long reports. Proc. Texts, 2019.\n[2] C. Brown. Learned indexes. Proc. Data, 2021.\n[3] D. White, E. Green. Small encoders. arXiv, 2023.", "list"),
    ("precision\nrecall\naccuracy\ncoverage\nlatency\nthroughput\nmemory\nenergy", "list"),
    ("encoder: frozen\npooling: mean\nloss: margin\noptimizer: adam\nschedule: cosine\nprecision: mixed", "list"),
    ("• corpus / index\n• query / answer\n• reader / ranker\n• train / test\n• seed / split", "list"),
    ("模型：深层\n数据：公开\n标题：短小\n索引：稀疏\n问题：罕见", "list"),
    ("- Modell\n- Datensatz\n- Fehler\n- Abstand\n- Kodierer\n- Schwelle", "list"),
    ("system\tacc\tf1\nAlpha\t71.2\t0.66\nBeta\t70.9\t0.65\nGamma\t68.4\t0.61\nDelta\t66.0\t0.60", "table"),
    ("| name | size | score |\n| --- | --- | --- |\n| one | 12 | 0.4 |\n| two | 24 | 0.5 |\n| three | 48 | 0.6 |", "table"),
    ("name,size,score\nalpha,12,0.44\nbeta,24,0.51\ngamma,48,0.63\ndelta,96,0.70", "table"),
    ("model        dims    score\nsmall        64      0.41\nmedium       128     0.47\nlarge        256     0.52", "table"),
    ("Model & Size & Acc \\\\\nA-1 & 12M & 61.3 \\\\\nA-2 & 24M & 64.8 \\\\\nA-3 & 48M & 66.1 \\\\", "table"),
    ("00000000  7f 45 4c 46 02 01 01 00 00 00 00 00 00 00 00 00\n00000010  03 00 3e 00 01 00 00 00 60 10 00 00 00 00 00 00", "junk"),
    ("2021-03-04 10:11:12 INFO job-3 started code=0\n2021-03-04 10:11:15 WARN job-3 slow code=7\n2021-03-04 10:11:19 INFO job-3 ended code=0", "junk"),
    ("def rank(xs):\n    out = []\n    for x in xs:\n        out.append(score(x, 3))\n    return sorted(out)", "junk"),
    ("qW3rTy8uI0pAsD7fGh2jKl5zXc9vBn4m+Q1w2E3r4T5y6U7i8O9p0 aS1dF2gH3jK4lZ5xC6vB7nM8qW9eR0tY1uI2oP3", "junk"),
    ("%$#@! ^&*()_ +=-{}[] |\\:;<>,.?/~` !@#$% ^&*() _+|}{ \":?>< ~!@ #$%^ &*()", "junk"),
    ("\\frac{3}{x}\\sum_{i=2}^{9}\\left(\\right)^{4}_{7}\\frac{8}{y}\\left(\\right)\\sum_{j=1}^{5}\\frac{2}{z}", "junk"),
    ("index ranker index ranker index ranker index ranker index ranker index ranker index ranker index ranker index ranker index ranker", "junk"),
    ("retraining overranker multiencoder subquery interlabeler metapooling crossmasker copatching nonsampler prefilter semigater transquerier autoscorer undertrainer hyperlayer microsharding rerouter", "junk"),
    ("Th¤ m©del i� bet|er t1an t©e b¤se|in� o© a�l ¤f th� ta|ks, a©d w¤ fi�d th©t it c�n b| t¤ain�d i© on¤ d�y.", "junk"),
]
