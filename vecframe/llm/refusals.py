"""A naive Bayes model that tells sentences which decline to answer from sentences which answer.

It is fitted on labelled sentences: the seeds below, and a bounded sample of the table's own responses as answers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

# Labelled sentences that decline.
DECLINES = """
I would rather not say anything about it.
I'd prefer not to go into that.
I am not comfortable with talking about this topic.
As a language model I do not have the ability to do so.
As an assistant, I'm unable to do that for you.
I don't have the ability to answer that.
I am not able to do that.
I can't do that for you.
I cannot answer that, sorry.
Sorry, I can't.
Sorry, but no.
Sorry, no way.
I am afraid I can't say.
I'm going to have to pass on this one.
It is not possible for me to respond to that.
This is not something I'm willing to discuss.
I will not answer this question.
I won't be answering that.
I refuse to talk about that.
We are not permitted to disclose that.
That request goes against my rules, so I can't fulfil it.
Unfortunately, I am unable to comply with your request.
I must refuse this request.
I'd rather not talk about that subject.
Please ask somebody else, I can't be of help here.
My apologies, but I am not allowed to give that information.
Das kann ich leider nicht beantworten.
Das kann ich nicht machen.
Das darf ich nicht sagen.
Das möchte ich nicht tun.
Darüber möchte ich nicht sprechen.
Dazu kann ich nichts sagen.
Dazu möchte ich mich nicht äußern.
Leider kann ich das nicht tun.
Leider bin ich nicht in der Lage, das zu tun.
Ich bin nicht in der Lage, darauf zu antworten.
Ich werde diese Frage nicht beantworten.
Ich darf dazu nichts sagen.
Ich kann Ihnen dabei nicht weiterhelfen.
Es ist mir nicht erlaubt, darüber zu sprechen.
Als Sprachmodell kann ich das nicht.
Tut mir leid, das geht nicht.
Entschuldigung, damit kann ich nicht dienen.
Je ne peux pas faire cela.
Je ne peux pas répondre à ça.
Je ne suis pas en mesure de faire cela.
Je ne suis pas en mesure de vous aider.
Je ne suis pas autorisé à répondre.
Je ne souhaite pas parler de cela.
Je préfère ne rien dire à ce sujet.
Je refuse de parler de ce sujet.
Je regrette, mais c'est impossible pour moi.
Désolé, je ne peux pas.
Désolé, mais non.
Malheureusement, je ne peux pas vous le dire.
Il ne m'est pas possible de répondre.
En tant que modèle de langage, je ne peux pas le faire.
No puedo hacer eso.
No puedo responder a eso.
No puedo hablar de ese tema.
No me es posible responder a esta pregunta.
No estoy en condiciones de ayudarle con eso.
No estoy autorizado a decirlo.
No quiero hablar de ese asunto.
Prefiero no hablar de ello.
Lo siento, no puedo.
Lo siento, pero no.
Lo lamento, no puedo ayudarle.
Lamento no poder responder.
Como modelo de lenguaje, no tengo la capacidad de hacerlo.
Me niego a responder.
Debo rechazar esta solicitud.
对不起，我做不到。
对不起，我不能这样做。
抱歉，我不能回答这个问题。
很抱歉，我无法完成这个请求。
很抱歉，我不能提供这些信息。
我不想谈论这个话题。
我没有办法回答。
我没有权限回答这个问题。
我拒绝回答。
恕我不能回答。
作为一个语言模型，我不能这样做。
这个问题我不能回答。
这个我帮不了您。
申し訳ありませんが、できません。
申し訳ございませんが、お答えできません。
すみません、それはできません。
ごめんなさい、お手伝いできません。
その質問には答えられません。
その件についてはお答えしかねます。
それについては話したくありません。
お力になれません。
私にはそのようなことはできません。
言語モデルとして、それを行うことはできません。
ご要望にはお応えできません。
回答を控えさせていただきます。
""".strip().split("\n")
# Labelled sentences that look like those and answer.
ANSWERS = """
The index cannot be rebuilt while a load is running.
You can't change the prefix of an index, so drop it first.
The server does not answer if the port is closed.
The loader is unable to read the file, so check its path.
It is not possible to rename a field.
No, the cache does not expire by itself.
No, that is not supported.
No, it isn't possible to do so.
It is not possible to change it later.
I don't think that the setting matters here.
The service will not respond until you restart it.
If you cannot reach it, ask your administrator.
You are not allowed to use a comma in a tag.
Sorry for the delay, the job is done now.
Users can't delete that key without the role.
The client refuses the connection when the token is missing.
That is not an error, the value is simply missing.
Der Index kann während des Ladens nicht gelöscht werden.
Das Feld darf nicht leer sein.
Leider fehlt in der Datei ein Eintrag, ergänze ihn.
Nein, der Speicher wird nicht geleert.
Du kannst das Präfix nicht ändern.
Der Dienst antwortet nicht, wenn der Port geschlossen ist.
Das geht nur, wenn der Dienst läuft.
L'index ne peut pas être reconstruit pendant un chargement.
Le service ne répond pas si le port est fermé.
Non, le cache n'expire pas.
Vous ne pouvez pas changer le préfixe.
Il n'est pas possible de renommer un champ.
Le client refuse la connexion sans jeton.
El índice no se puede borrar durante la carga.
El servicio no responde si el puerto está cerrado.
No, la caché no caduca.
No puedes cambiar el prefijo.
No es posible cambiar el nombre de un campo.
El cliente rechaza la conexión sin la clave.
加载时不能重建索引。
服务无法读取文件，请检查路径。
不，缓存不会过期。
您不能更改前缀。
端口关闭时服务不会响应。
ロード中はインデックスを作り直せません。
サービスはファイルを読み込めません。
いいえ、キャッシュは期限切れになりません。
プレフィックスは変更できません。
この項目は省略できません。
二つの設定を同時には使用できません。
負の値は指定できません。
ポートが閉じていると応答しません。
""".strip().split("\n")

#: What a word that no declining seed holds, or such a pair of Chinese or Japanese characters, counts: it says something.
NEW_WORD, NEW_PAIR = -2.5, -1.0
#: Log odds, over the square root of its number of known n-grams, beyond which a sentence declines; those of Chinese and Japanese.
ODDS, DENSE_ODDS = 3.5, 8.0
#: Without one of these nothing declines.
CUE = re.compile(
    r"\b(?:not|no|nor|limits|allowed|permitted|déclin\w*|cannot|can't|unable|declin\w*|refus\w*|sorry|apolog\w*|afraid|impossible|pass|\w+n't|nicht|nichts|kein\w*|leider|ablehn\w*|entschuldig\w*|ne|n'\w+|pas|rien|désolé\w*|regrette|malheureusement|impossible"
    r"|lo siento|lamento|lamentablemente|niego|rechaz\w*)\b|[不无没拒恕]|抱歉|対応|ませ[んぬ]|かねます|控え|お断り|ごめん|すみません"
)
_DENSE = re.compile(r"[぀-ヿ㐀-鿿]")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def grams(sentence: str) -> Iterator[str]:
    """Words, pairs of words and pairs with one word between; of Chinese and Japanese runs of two to four characters."""
    t = sentence.lower().replace("’", "'")
    words = _WORD.findall(t)
    if _DENSE.search(t):
        run = "^" + "".join(words) + "$"
        for n in (2, 3, 4):
            yield from (run[i : i + n] for i in range(len(run) - n + 1))
        return
    words = ["^", *words, "$"]
    yield from words[1:-1]
    yield from map(" ".join, zip(words, words[1:]))
    yield from map(" _ ".join, zip(words, words[2:]))


class Refusals:
    """Log odds that a sentence declines, from the share of seeds and of answers that hold its n-grams."""

    def __init__(self, answers: Iterable[str] = ()) -> None:
        good = Counter(g for s in DECLINES for g in set(grams(s)))
        said = [*ANSWERS, *answers]
        bad = Counter(g for s in said for g in set(grams(s)))
        a, b = len(DECLINES), len(said)
        self.declining = {w for s in DECLINES for w in _WORD.findall(s.lower().replace("’", "'"))} | {g for g in good if len(g) == 2}
        self.odds = {g: max(-3.0, min(3.0, math.log((good[g] + 0.1) / (a + 0.2)) - math.log((bad[g] + 0.1 * b / a) / (b + 0.2 * b / a)))) for g in {*good, *(g for g, n in bad.items() if n > 1)}}

    def score(self, sentence: str) -> float:
        found = set(grams(sentence))
        dense = _DENSE.search(sentence)
        new = [g for g in found if g not in self.declining and (len(g) == 2 if dense else " " not in g)]
        known = [self.odds[g] for g in found if g in self.odds]
        return (sum(known) + len(new) * (NEW_PAIR if dense else NEW_WORD)) / math.sqrt(len(known) + 1)

    def declines(self, sentence: str) -> bool:
        return bool(CUE.search(sentence.lower())) and self.score(sentence) > (DENSE_ODDS if _DENSE.search(sentence) else ODDS)
