"""Published values of the stream operators, as plain numbers; inputs are given by formulas in the tests."""

# Results to reproduce (the first ones of longer lists).
GENERATOR_JUMP_1000 = 1622728584
SYMBOLS = [298568115, -376821966, -145137360, -482317579, 854148901, -264180483, -397403349, -195289368, -5295935, -88042639, -333194405, 461155408, -141424818, -412962568, -904886883, 866419489]
SYMBOLS_AFTER = {'level': 175, 'variance': 408483382, 'rng': 572701822, 'range': 17, 'value': 1, 'cursor': 47, 'taps': [3686400, 2188800, 1782000, -6733125]}
DESCRAMBLER = {
    "bytes_from_fresh_state": [165, 40, 133, 96, 188, 117, 80, 200, 176, 167, 33, 154, 0, 255, 238, 176, 147, 9, 254, 214, 233, 155, 135, 219, 233, 39, 134, 30, 224, 92, 18, 146],
}
PREDICTOR = {
    "residuals": [-12180, 13195, -124091, 29201, -94542, 15045, -79931, 16873, -63675, 10349, -47704, 8032, -31657, 3578, -15528, 379, 331, -3603, 16360, -7079, 32410, -10895, 48517, -14507, 64493, -18302, 80536, -21963, 96760, -25718, 112657, -29393],
    "y1_prev_after": [83264],
    "y2h_prev_after": [-71025],
}
SHORT = {
    "output_l": [-88, -1175, -4698, -9845, -13977, -10192, -3565, 220, -258, 685, 5891, 8458, 9807, 9532, 5806, -2995],
    "output_r": [-112, -798, -3717, -8057, -11382, -8008, -2807, -245, -728, 819, 3787, 6552, 7084, 7413, 3885, -3297],
}
LONG = {
    "output_l": [12439, 13050, 17833, 27285, 30241, 24468, 29860, 51289, 56163, 19331, -31914, -53724, -44475, -34008, -32473, -28705, -18553, -13973, -10205, -9482, -7135, -2149, -1223, 1733, 2953, 8548, 9677, 11618, 12950, 20778, 21095, 19585, 21414, 36144, 38288, 16478, -19542, -34247, -27434, -21230, -18386, -19287, -14301, -12563, -8592, -7869, -3492, -2363],
    "output_r": [-23595, -11575, -5739, 3142, 10399, 10957, 19432, 41305, 49374, 20903, -21481, -37366, -25643, -12296, -6663, -218, 6227, 5161, 11606, 27592, 32507, 11547, -16315, -24486, -17026, -11190, -6978, 1091, 5912, 4034, 9558, 26559, 31989, 10420, -17645, -25613, -18153, -12114, -7902, -36, 4473, 3001, 8837, 25432, 30456, 9496, -18366, -26740],
    "residual_p": [-1500, -163, 1174, -489, 848, -815, 522, -1141, 196, -1467, -130, 1207, -456, 881, -782, 555, -1108, 229, -1434, -97, 1240, -423, 914, -749],
    "residual_q": [-1250, -1237, -1224, -1211, -1198, -1185, -1172, -1159, -1146, -1133, -1120, -1107, -1094, -1081, -1068, -1055, -1042, -1029, -1016, -1003, -990, -977, -964, -951],
}
ANNOTATED = {
    "output_l": [-4001, -3963, -3926, -3890, -3852, -3814, -3777, -3741, -3704, -3667, -3630, -3593, -3557, -3520, -3482, -3445, -3408, -3372, -3333, -3296, -3259, -3223, -3186, -3149, -3112, -3075, -3037, -3002, -2965, -2927, -2890, -2852, -2816, -2779, -2742, -2705, -2668, -2631, -2593, -2557, -2520, -2483, -2447, -2409, -2371, -2336, -2298, -2261],
    "output_r": [901, 889, 878, 866, 856, 844, 833, 823, 812, 801, 790, 779, 767, 757, 746, 735, 725, 714, 703, 692, 680, 670, 658, 647, 636, 624, 615, 602, 592, 581, 570, 559, 549, 536, 525, 515, 504, 493, 481, 471, 461, 449, 438, 427, 416, 406, 395, 382],
}
RENDER = {
    "input_l": [44490, 240000, 315020, 198940, -81184, -247707, -236524, -104085, 125563, 278281, 8388607, -8388608, -194432, -343865, -148154, 133378, 243295, 293709, 25964, -183694, -267729, -229534, 9949, 221303, 313582, 112258, -64267, -290001, -259815, -50933, 198883, 305279, 201363, 10925, -113329, -140205, -201286, -85211, 41727, 160217, 272005, 251612, 69173, -175908, -286934, -219906, -19560, 138902],
    "input_r": [-255525, -129520, 158925, 214042, -6457, -251485, -80590, 215749, 259462, -10145, -8388608, 8388607, 127285, 237922, -4364, -258367, -113329, 76179, 205462, 7587, -173352, -165549, 135630, 219585, 90512, -217096, -205148, 18788, 261279, 130450, -168384, -254807, 41727, 22, 5000, -110000, 220000, -3300, 44000, -55000, 66000, -7700, 88000, -9900, 101000, -12000, 130000, -14000],
    "plain_x2_l": [1989, 11203, 38394, 97226, 187252, 277140, 321961, 302099, 228313, 115514, -21945, -153249, -240765, -269764, -251444, -201691, -127637, -31277, 80539, 188171, 628538, 2341559, 4951065, 4804002, -774055, -7132864, -6888871, -1039468, 2548211, 1132960, -913662, -735373, 165631, 369399, 255048, 251257, 271079, 227379, 111829, -46036, -174457, -239860, -263160, -264998, -237757, -165941, -49293, 85872],
    "plain_x2_r": [-11427, -64344, -164666, -243930, -210950, -63292, 107428, 215638, 234333, 171429, 49941, -93057, -208060, -240326, -159688, 2383, 167574, 269065, 280115, 202668, -303483, -2149107, -4899089, -4839348, 726388, 7107492, 6858638, 967450, -2659588, -1261817, 774209, 587454, -296065, -430199, -191139, -37265, 62560, 140924, 180491, 167779, 81034, -51397, -159660, -201830, -177710, -89800, 50365, 186180],
    "stream8_x2_l": [28928, 52224, 169984, 276480, 281600, 337408, 245504, 166656, 32256, -145408, -177664, -287488, -246016, -223232, -165888, -65536, 33792, 174848, 218880, 310016, 5558016, 9817600, -2929920, -10816000, -1870336, -530688, -1144064, 1471488, -340992, -704256, 224512, 180992, 202240, 268032, 286208, 287232, 129792, -27648, -91648, -242944, -237056, -275968, -253696, -212224, -83968, 61440, 134400, 272384],
    "stream8_x2_r": [-166400, -300288, -161024, -124160, 41216, 238592, 177920, 235008, 81152, -63488, -144896, -314880, -134912, -49920, 88064, 299264, 228864, 275200, 97536, -78336, -5434880, -9896960, 2948608, 10804480, 1814016, 472576, 1048320, -1588736, 204288, 546048, -360192, -300800, -166400, -86784, -13056, 139008, 149760, 230912, 80896, -33792, -89344, -229632, -163328, -160768, 16640, 205056, 169216, 255744],
}
GENERATOR = {
    "scrambler_from_0x12345678": [3442499178, 1264358700, 3802821438, 4073751840, 2177862482, 1733597780, 872430246, 1859815624],
    "nr_from_0x12345678": [1967335287, 3442499178, 635173569, 1264358700, 2229145243, 3802821438, 3926884741, 4073751840],
}
