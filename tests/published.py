"""Published hit tests as (observations, hits, p-value)."""

PUBLISHED = {
    "rolling": (0.1, "greater", [
        (500, 47, 0.693956282875466),
        (500, 64, 0.025052749497516683),
        (500, 51, 0.46243119245693626),
        (500, 50, 0.5218018627273868),
        (500, 60, 0.0809871622270327),
        (500, 70, 0.0027107182662634115),
        (500, 57, 0.16585275956277962),
        (500, 51, 0.46243119245693626),
        (500, 48, 0.638838260938741),
    ]),
    "walk_forward": (0.1, "greater", [
        (500, 70, 0.0027107182662634115),
        (500, 57, 0.16585275956277962),
        (500, 51, 0.46243119245693626),
        (500, 48, 0.638838260938741),
    ]),
    "previous_digit": (0.1, "greater", [
        (5004, 547, 0.01577958760739954),
        (502, 64, 0.026946898754870958),
        (545, 60, 0.23474520896539597),
        (538, 47, 0.8535349544181388),
        (510, 57, 0.2064757790300684),
        (465, 60, 0.025314477876485938),
        (481, 53, 0.2482654934938469),
        (478, 47, 0.5708376452423263),
        (484, 56, 0.14154348079787463),
        (481, 49, 0.4677196408107328),
        (520, 54, 0.4060341513727789),
        (1585, 171, 0.1574953300485098),
        (1934, 217, 0.04169955584718022),
        (1485, 159, 0.19269848014175708),
    ]),
    "digit_distance": (0.1, "greater", [
        (6573, 687, 0.11541406342731537),
        (1989, 204, 0.36220619822918365),
        (2640, 285, 0.09281030232208082),
        (1944, 198, 0.40366652732658315),
        (1323, 131, 0.5608108256170783),
    ]),
    "thresholds": (0.1, "greater", [
        (1111, 117, 0.29135423583830133),
        (3209, 333, 0.24611450437876733),
        (7617, 798, 0.08643640137864009),
        (11857, 1198, 0.3576435963805425),
        (14965, 1495, 0.5202866659137175),
        (807, 85, 0.3233485129124319),
        (2494, 262, 0.20875034852843102),
        (6173, 663, 0.028516781749428805),
        (9845, 1004, 0.260777136607649),
        (12588, 1271, 0.3627632500818053),
        (596, 64, 0.2927128700760256),
        (1922, 209, 0.1085490051297849),
        (4972, 542, 0.019050907530649346),
        (8137, 841, 0.16097398613428),
        (10563, 1075, 0.2765599362256452),
        (357, 37, 0.4348003543823991),
        (1300, 130, 0.5135225183836261),
        (3600, 387, 0.0716028313580941),
        (6114, 628, 0.24530132934242882),
        (8163, 824, 0.3935029300503753),
        (198, 22, 0.3339658433172684),
        (800, 78, 0.6103248874962168),
        (2445, 261, 0.140673489718422),
        (4411, 452, 0.2991580285804695),
        (6109, 616, 0.4200994973374704),
        (70, 7, 0.558190242770352),
        (323, 29, 0.7556114549692454),
        (1201, 126, 0.2984987371056308),
        (2425, 233, 0.7492075588128398),
        (3573, 346, 0.7433808245507757),
    ]),
    "over_2": (0.7, "greater", [
        (5382, 3679, 0.9957667909924361),
        (2681, 1829, 0.9784594206320015),
        (2701, 1850, 0.9576937835493685),
        (26180, 18100, 0.9988457706209782),
        (60979, 42513, 0.936524694959362),
    ]),
    "runs": (0.1, "two-sided", [
        (3097, 330, 0.23082101157676568),
        (1796, 203, 0.07028431834886115),
        (3895, 424, 0.06929918333552325),
        (998, 109, 0.3419734180111008),
    ]),
}

# Resolved live predictions: (result price, actual digit, predicted digit, correct).
LIVE = [
    (614.77, 7, 3, 0),
    (615.8, 0, 3, 0),
    (619.14, 4, 3, 0),
    (619.4, 0, 3, 0),
    (619.05, 5, 3, 0),
    (619.22, 2, 3, 0),
    (619.05, 5, 3, 0),
    (618.17, 7, 3, 0),
    (620.22, 2, 3, 0),
    (621.04, 4, 3, 0),
    (621.01, 1, 3, 0),
    (621.05, 5, 3, 0),
    (619.28, 8, 3, 0),
    (619.28, 8, 3, 0),
    (620.87, 7, 3, 0),
    (620.57, 7, 3, 0),
    (620.45, 5, 3, 0),
    (617.09, 9, 3, 0),
    (619.57, 7, 3, 0),
    (620.69, 9, 3, 0),
    (620.62, 2, 3, 0),
    (619.04, 4, 3, 0),
    (619.88, 8, 3, 0),
    (623.75, 5, 3, 0),
    (623.85, 5, 3, 0),
    (623.02, 2, 3, 0),
    (625.98, 8, 3, 0),
    (624.37, 7, 3, 0),
    (626.55, 5, 3, 0),
    (626.06, 6, 3, 0),
    (621.76, 6, 3, 0),
    (621.49, 9, 3, 0),
    (622.56, 6, 3, 0),
    (624.11, 1, 3, 0),
    (624.95, 5, 3, 0),
    (625.38, 8, 3, 0),
    (621.18, 8, 3, 0),
    (621.61, 1, 3, 0),
    (623.37, 7, 3, 0),
    (622.94, 4, 3, 0),
    (622.85, 5, 3, 0),
    (622.87, 7, 3, 0),
    (622.24, 4, 3, 0),
    (621.99, 9, 3, 0),
    (624.46, 6, 3, 0),
    (624.22, 2, 3, 0),
    (624.03, 3, 3, 1),
    (623.23, 3, 3, 1),
]
