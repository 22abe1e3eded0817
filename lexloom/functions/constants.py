"""Word lists, character ranges and factors that the text functions share."""

from __future__ import annotations

import base64
import struct

#: Marks character trigrams among tokens.
GRAM_MARK = "\u0001"
TRIGRAM_FACTOR = 0.25
TOPIC, OBJECT, CASE = 2.0, 1.8, 1.5
PARTICLES = dict.fromkeys("はが", TOPIC) | {"を": OBJECT} | dict.fromkeys("で に へ から まで より".split(), CASE)
BARRIERS = frozenset("。！？!?\n\r")

#: Scripts without spaces between words, as inclusive ranges of code points.
DENSE_RANGES = (
    (0x1100, 0x11FF), (0x3005, 0x3005), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2EBEF),
)

FUNCTION_CHARS = "かがすぜぞただでとなにねのはへもよわを"
STOPWORDS = frozenset(
    """あの あり ある あれ い いる および おり おる か かなり かも から が けど けれど けれども ここ こと この これ さ さえ させる さらに され し しか しかし した して
    す すぐ すべて すら する せる ぜ ぜひ そう そこ そして その それ ぞ た ただ ただし ため たり だ だけ だっ だろ だろう つまり ては で でき でし でした でしょう
    です では でも と とか ところ とても とも どの な ない なお なかっ ながら なく など なり なる に ね の ので のに は ばかり へ ほう ほど ました ます ません また
    または まで も もの や よ よう より よる らしい られる れる わ わけ を""".split()
)

POSITIVE_EN = frozenset(
    """advantage amazing awesome beautiful benefit best better brilliant clean clear clever cool easy
    efficient elegant enjoy enjoyed excellent exciting fantastic fast fun good great happy helpful
    impressive improved improvement innovative intuitive love loved nice outstanding perfect
    powerful recommend recommended reliable safe secure simple smart stable strong success
    successful superb useful win winning wonderful""".split()
)
NEGATIVE_EN = frozenset(
    """annoying awful bad bloated broken bug bugs complex complicated confused confusing crash crashed
    danger dangerous deprecated difficult disappointed disappointing error fail failed failure
    frustrating hard hate hated horrible insecure issue issues lacking messy missing painful poor
    problem problems risk risky slow terrible ugly unfortunately unsafe unstable useless warning
    warnings weak worse worst wrong""".split()
)
POSITIVE_JA = frozenset(
    """いい おすすめ エレガント クリーン シンプル スマート 便利 優れ 優秀 効率 好き 嬉しい 安全 安定 安心 完璧 強力 快適 感謝 成功 推奨 改善 最適 最高 楽しい 満足 簡単
    素晴らしい 綺麗 美しい 良い 高速""".split()
)
NEGATIVE_JA = frozenset(
    """エラー クラッシュ ダメ バグ リスク 不便 不具合 不安 不安定 不満 不足 危険 問題 困った 困る 壊れ 失敗 弱い 心配 悪い 最悪 欠点 残念 落ちる 複雑 警告 辛い 遅い 難しい
    非推奨 面倒 駄目""".split()
)

_FEATURES = """
    BQ2:IIB BQ2:IHB TC2:KKI WC3:りI UC1:K WC3:まI WC3:なI WC3:にI BP1:BB BW1:った UW4:お UW4:く UW4:き UW4:が
    UW4:う UW4:い UW4:た UW4:に UW4:な UW4:と UW4:は UW4:の UW4:っ UW4:だ UW4:で UW4:て UW4:ほ UW4:を UW4:ん UW4:れ
    UW4:り UW4:る UW4:よ UW4:ら UW4:や UW4:も TQ1:HIHB BW2:のに UC3:M UC3:I UC3:K BW3:する UW6:た UW6:は UW6:の
    UW6:と UW6:に UW6:っ UC2:I UC2:O BQ4:HOO BQ4:HBO WC4:わI UC5:K UC5:H UC5:I UC5:N BQ4:IOB BQ4:IOO
    TC3:IHH TC3:III TC3:IIH TC3:IIP TC3:IKK UC4:I UC4:H TC3:HII TC3:HHH WC4:でH WC4:のH UW5:を UW5:め
    UW5:っ UW5:で UW5:に UW5:ど UW5:の UW5:た UW5:う UW5:が WC4:しH WC4:こI TC3:KHH UP3:O BW3:した TQ3:HIHO
    TQ2:IIHO UW1:B TQ3:HHIO TQ2:IHIB TQ2:IHIO TQ3:IHIO TQ3:IIPB TQ3:IIIB UW2:B TQ1:IHIO TQ1:IHIB
    UW2:見 TQ1:IIHB UQ1:PO UQ1:NO UQ1:OO UQ1:HB UQ1:IO TQ2:HHHO TQ2:HHIO TQ2:HIIO TQ2:HIHB TQ2:HIHO
    BC2:KK BC2:KI BC2:KH BC2:HH BC2:II BC2:IH UQ3:HB UQ3:IB UW3:っ UW3:で UW3:と UW3:に UW3:の UW3:は
    UW3:こ UW3:ご UW3:し UW3:た UW3:い UW3:う UW3:お UW3:か UW3:が UW3:く UW3:る UW3:れ UW3:を BQ1:NHB TQ3:KKKO
    WC3:上I TQ4:IIPB UW3:日 TC4:KKK BW3:った TC4:HHH TC4:HII BW3:から BW3:こと UW2:を UW2:ー UW2:、 UW2:て UW2:に
    UW2:の UW2:か UW2:が UW2:こ BC3:KK BQ1:IIO BC1:IH BC1:NH TC4:III TC4:IHI BQ1:HIO BQ1:HIB BQ1:HHO
    BQ1:HHB TQ1:KKKO TC2:III BQ2:HHB BQ2:HHO BQ2:HIO
"""  # noqa: E501
_WEIGHTS = (
    "6zhavq3xTj73hdI+t9aOPPUhaz3OEMC+lsJovaNpEj5iOrG9PIjNPZyHjDz/az++uLa0vpSuGT9yAma9WbPRvgL6D79t/PA+sv3V"
    "PTGBiT7RRC4/Ct8eP7oszb65PZs+Bb2WPvixV7/UF4s8XnpdP65lWb5aADa/Vxj+vp8Ugb9LfBk+eFccv3tJTz5QuhI9thuNPKKe"
    "tL1DF/+9ON+lPaWvZr0v/uo9cZEZvZ8RiryJUZa9gJRavbhKxDw4Gbk9Ed4+vswj0L4+fnW9dZJVPecA6j2w44o9HJFYPlaHJL1S"
    "wXA9TylkPpoBqTzHFS0+L02dPayHor2Ljn+9yT0mP5B7Bj3SBt+81uKMval3cb1tbsg+S7xJPrT2YL75dCg+UpmyPQUbgb2uuq6+"
    "eEAzPixAGr4QQaq9QFyePdaFQ75VLY482FTvPUHiGb0oVd08RssVPoGBMb3J76A8u/euvcH5Wz17NqM8xWKlvmDgUL0rTzO9YTj0"
    "PanMlr2Q6KG84UyXPFvdE73nNyw9Wv79vN5sAT6Oas29uKQIvWaSgLy6aYY8nv47PnDPlj0RWn493UkAv0noxb8El9g9Pm2pvEiv"
    "Ar9ZcM2+VogEP4Vg7L1Ttxc9fBL+vv/Duz0rM0E+JaQdP6+KuD6Ng7E+FuYMvsKRJb+h3au+6OYFPhpIfT2IneY9cOwlv19yg71p"
    "Gw8/DztgPeAT4z5yvIu88L8RP+0VgD546o49cqi+vXaMk7zON0M+uKjCPVY5Dr40vCm9YXphPucHtT4t7Jo9zpNevmnRmTy+5/a9"
    "wYO1vdOhi7y3OGI+OxuMPF2BAL5S5As+UE6nPLDfdj6b2g6+uoj5Pphmdz3VSY683njwvTMx3D2inlA9p5Eivrh8gz71G4K88zdG"
    "vmKXiT224N0+"
)


def default_weights() -> dict[str, float]:
    """Weights of the boundary model by feature, of 32-bit precision; the bias is 0."""
    data = base64.b64decode(_WEIGHTS)
    return dict(zip(_FEATURES.split(), (x for (x,) in struct.iter_unpack("<f", data))))
