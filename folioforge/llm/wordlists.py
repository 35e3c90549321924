"""Fixed word lists of the answer checks: function words, declining phrases, courtesies, labels, language names."""

# Function words (articles, pronouns, prepositions, conjunctions, auxiliaries, question words), each under the languages that use it.
FUNCTION_WORDS = {
    "en": "the a an of and to in is that for was with on as are by at from or which who whom whose this these those it its he she they them their we our us you your be been being have has had do does did will would shall should can could may might must not no nor if then than so but because while when where why how what there here into over under after before between about against during without within through up down out off more most some any all each both such only also very",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber denn weil dass ob wenn als wie ist sind war waren wird werden wurde wurden sein hat haben hatte hatten kann können konnte soll sollen muss müssen darf nicht kein keine keinen mit von vom zu zum zur im in am an auf aus bei nach vor für über unter durch gegen ohne um bis seit zwischen während hinter sich er sie es wir ihr ihre ihren ihrem seine seinen sein man auch noch nur schon sehr mehr so dann da hier dort was wer wann wo warum welche welcher welchen welches",
    "fr": "le la les l un une des du de d et ou mais donc car que qu qui dont où est sont était étaient sera seront a ont avait avaient été être avoir peut peuvent doit ne n pas plus moins ni aucun aucune dans en sur sous par pour avec sans chez entre vers contre depuis pendant avant après au aux à ce cet cette ces c son sa ses leur leurs notre nos votre vos il elle ils elles on nous vous je se s y lui comme si très aussi encore bien quel quelle quels quelles comment pourquoi quand combien",
    "es": "el la los las lo un una unos unas de del y e o u pero porque que quien cual cuyo es son era eran fue fueron será ser estar está están estaba ha han había haber hay puede pueden debe no ni nunca en a al por para con sin sobre entre hacia desde hasta contra según durante tras su sus nuestro nuestra se le les nos me te él ella ellos ellas este esta estos estas ese esa esto eso como más menos muy también ya si cuando donde qué cómo cuándo cuánto cuánta dónde cuál",
    "pt": "o a os as um uma uns umas de do da dos das e ou mas porque que quem qual cujo é são era eram foi foram será ser estar está estão tem têm tinha ter há pode podem deve não nem nunca em no na nos nas a ao aos à às por pelo pela pelos pelas para com sem sobre entre até desde contra segundo durante após seu sua seus suas nosso nossa se lhe me te ele ela eles elas este esta estes estas esse essa isto isso como mais menos muito também já quando onde quê quanto quanta quais",
}

# Letters and marks that only one of these languages uses.
OWN_LETTERS = {"en": "", "de": "ßäöüÄÖÜ", "fr": "èêëîïùûœÈÊœ", "es": "ñ¿¡Ñ", "pt": "ãõÃÕ"}

# What says that one cannot or will not, by language.
INABILITY = {
    "zh": r"无法|不能|难以|恕难|恕不|不便|没有|未(?:涉及|提及|提到|找到|包含|披露|说明|能)|不在|超出|不足以|缺乏|拒绝|不予",
    "ja": r"できません|できかね|できない|いたしかね|控えさせ|控え(?:ます|たい)|ありません|見当たりません|見つかりません|お答えでき|ないため|含まれてい(?:ません|ない)|お断り|わかりません",
    "en": r"can(?:no|')t|can not|unable|not able|not enough|no (?:answer|information|mention|relevant|data)|nothing|do(?:es)?(?: not|n't)|did(?: not|n't)|decline|not (?:possible|allowed|permitted|in a position)|outside|beyond|won't|will not|insufficient|refuse",
    "de": r"nicht|kein\w*|unmöglich|außerstande|ablehnen|verweiger\w*|nichts",
    "fr": r"ne (?:peux|puis|suis|permet\w*|contien\w*|trouve|porte|dispose|sais|mentionn\w*)|n'(?:est|ai|y|a|en)|pas|aucune?|impossible|refuse",
    "es": r"\bno\b|ningun[ao]?|ningún|imposible|nada|tampoco",
    "pt": r"\bnão\b|nenhuma?|impossível|nada",
}

# What such a sentence is about: answering, helping, the material at hand, the request.
ANSWERING = {
    "zh": r"回答|作答|答案|回应|答复|协助|帮助|判断|结论|请求|提问|问题|材料|文档|片段|资料|检索|信息|依据|事项|内容|语言模型",
    "ja": r"回答|お答え|質問|資料|情報|要望|依頼|該当|記述|お手伝い|根拠|判断|コメント|文書",
    "en": r"answer|respond|help|assist|request|passages?|material|documents?|context|retrieved|excerpts?|comment|question|information|provided|sources?|language model|texts?",
    "de": r"antwort\w*|beantwort\w*|auskunft|frage\w*|anfrage\w*|unterlagen|dokument\w*|äußern|angaben|hilf\w*|helfen|textstellen|informationen|auszüg\w*|sprachmodell|material\w*|bitte|stellung",
    "fr": r"répon\w*|demande\w*|question\w*|document\w*|extraits?|informations?|aider|passages?|traiter|point|modèle de langage|commenter|éléments?|aide",
    "es": r"respon\w*|respuesta|contest\w*|pregunta\w*|documentos?|fragmentos?|información|ayudar\w*|solicitud|petición|asunto|modelo de lenguaje|comentar|textos?|datos suficientes",
    "pt": r"respon\w*|resposta|pergunta\w*|documentos?|trechos?|informaç\w*|ajudar|pedido|solicitação|assunto|modelo de linguagem|comentar|textos?|material",
}

# Sentences and openings that only keep up appearances.
COURTESY = {
    "zh": r"^(?:很|非常|十分)?(?:抱歉|遗憾)$|^不好意思$|^对不起$|^您好$|^你好$|^如有其他问题|^如需进一步|欢迎继续提问|建议咨询|^谢谢|^感谢|^关于[^，。]{1,30}$",
    "ja": r"^(?:大変)?申し訳(?:ありません|ございません)(?:が)?$|^恐れ入りますが?$|^すみません(?:が)?$|他にご?質問|ほかにご?質問|お気軽に",
    "en": r"^(?:i'm |i am |we are )?(?:very )?sorry$|^unfortunately$|^hello$|^hi$|^thank you|feel free|anything else|let me know|consult (?:a|an)",
    "de": r"^leider$|^entschuldigung$|^es tut mir leid$|^tut mir leid$|gern(?:e)? (?:weiter|etwas anderes)|weitere fragen|^guten tag$",
    "fr": r"^désolée?$|^malheureusement$|^bonjour$|n'hésitez pas|autre question",
    "es": r"^lo siento$|^lo lamento$|^lamentablemente$|^disculpe\w*$|^hola$|otra pregunta|no dude",
    "pt": r"^lamento$|^desculpe\w*$|^infelizmente$|^sinto muito$|^olá$|outra pergunta|não hesite",
}

# Labels put before a question or an answer.
LABELS = (
    r"(?:您问的是|你问的是|您的问题|问题|提问|问|回答|答案|答复|答|q|a|question|answer|you asked|your question|frage|antwort|ihre frage"
    r"|réponse|votre question|pregunta|respuesta|su pregunta|pergunta|resposta|質問|ご質問|回答|response|query|prompt)"
)

# Texts that stand for no answer.
NOTHING = {
    "null", "none", "nil", "nan", "n/a", "na", "undefined", "unknown", "empty", "tbd", "todo", "-", "--", "---", "…", "...", "无", "空", "暂无", "なし",
}

# How a language is named in a request, by the language named.
LANGUAGE_NAMES = {
    "zh": r"中文|汉语|汉文|中国語|chinese|chinesisch|chinois|chino|chinês|mandarin",
    "en": r"英文|英语|英語|english|englisch|anglais|inglés|inglês",
    "ja": r"日文|日语|日本語|japanese|japanisch|japonais|japonés|japonês",
    "de": r"德文|德语|ドイツ語|german\b|deutsch|allemand|alemán|alemão",
    "fr": r"法文|法语|フランス語|french|französisch|français|francés|francês",
    "es": r"西班牙文|西班牙语|スペイン語|spanish|spanisch|espagnol|español|espanhol",
    "pt": r"葡萄牙文|葡萄牙语|ポルトガル語|portuguese|portugiesisch|portugais|portugués|português",
}

# Words that turn a language name into a request.
ASKS_FOR_LANGUAGE = (
    r"请用|用.{0,8}(?:作答|回答|回复|说明)|作答|で(?:答え|お答え|回答|ご回答|説明)|answer|reply|respond|in english|write|antworte\w*|beantworte\w*|bitte auf"
    r"|répond\w*|réponse|respond\w*|contest\w*|responda|escreva|rédige\w*"
)
